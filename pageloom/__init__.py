"""Captured web pages to documents, link graphs, rankings and telemetry on Spark."""

from __future__ import annotations

from importlib import import_module

# Names are looked up when they are first asked for: a Python worker that needs one module does not load all of them.
_HOME = {
    "pageloom.operators.document": ("extract_documents", "visible_text",),
    "pageloom.operators.graph": ("crawl", "lookup", "site_map",),
    "pageloom.operators.guard": ("guard", "has_injection", "wrap",),
    "pageloom.operators.harvest": ("harvest", "search_all", "seed_union",),
    "pageloom.operators.links": ("document_links", "link_edges", "page_links",),
    "pageloom.operators.pack": ("context_pack",),
    "pageloom.operators.rank": ("domain_cap", "expand_query", "relevance", "top_relevant",),
    "pageloom.operators.telemetry": ("global_summary", "page_facts", "run_summary",),
    "pageloom.operators.triage": ("triage",),
    "pageloom.session": ("configure",),
    "pageloom.sources.captures": ("read_pages", "target_pool",),
    "pageloom.sources.store": ("Store",),
}
__all__ = sorted(name for names in _HOME.values() for name in names)


def __getattr__(name: str) -> object:
    for module, names in _HOME.items():
        if name in names:
            return getattr(import_module(module), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
