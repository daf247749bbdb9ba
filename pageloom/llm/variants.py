"""Spelling variants of the vocabulary by composing its minimal acceptor with a one-edit transducer."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.frames import table
from pageloom.session import cut_lineage

MIN_LENGTH, MIN_COUNT, RATIO, ONE_IN = 7, 2, 10, 31
#: Words of one partition of the composition; larger partitions are parted further.
GROUP = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts.

    Words are maximal runs of Latin letters, A-Z in lower case. One in ``one_in`` (pairs of id and run, by their crc32) loses
    one letter. Counts are summed up in each task before the shuffle.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def minimal_acceptor(words: list[str]) -> tuple[int, list[tuple[bool, dict[str, int]]]]:
    """Start and states (final, arcs) of the smallest deterministic acceptor of sorted distinct words.

    States behind the last word are closed as soon as the next one leaves them; equal ones become one.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, dict[str, int]]] = []
    arcs: list[dict[str, int]] = [{}]
    final = [False]
    last = ""

    def close(depth: int) -> int:
        state = -1
        while len(arcs) > depth:
            key = (final.pop(), tuple((mine := arcs.pop()).items()))
            state = register.setdefault(key, len(states))
            if state == len(states):
                states.append((key[0], mine))
            if arcs:
                arcs[-1][last[len(arcs) - 1]] = state
        return state

    for word in words:
        same = len(commonprefix([last, word]))
        close(same + 1)
        for _ in word[same:]:
            arcs.append({})
            final.append(False)
        final[-1] = True
        last = word
    return close(0), states


def _spelled(node: tuple | None) -> str:
    out = []
    while node:
        node, letter = node
        out.append(letter)
    return "".join(reversed(out))


class OneEdit:
    """Acceptor, one-edit transducer and the same acceptor, composed.

    Before the edit both sides are in one state, as the acceptor is deterministic; after it they read the
    same letters. ``pairs`` walks the states before the edit and, from each, the states after it.
    """

    def __init__(self, words: list[str]):
        self.start, self.states = minimal_acceptor(words)
        self.known: dict[int, list[tuple[str, str]]] = {}

    def _both(self, p: int, q: int, but: str) -> list[str]:
        """Words that both states accept, those that begin with ``but`` left out."""
        found, stack = [], [(p, q, None)]
        while stack:
            p, q, node = stack.pop()
            (end, mine), (other_end, other) = self.states[p], self.states[q]
            if end and other_end:
                found.append(_spelled(node))
            if len(other) < len(mine):
                mine, other = other, mine
            for letter, x in mine.items():
                y = other.get(letter)
                if y is not None and (node or letter != but):
                    stack.append((x, y, (node, letter)))
        return found

    def _edits(self, state: int) -> list[tuple[str, str]]:
        """Rests of all accepted pairs whose first unlike place is this state: the shorter, or smaller, first.

        A letter put in before an equal letter is left to the state behind that one, so each pair is found once.
        """
        if state not in self.known:
            arcs = sorted(self.states[state][1].items())
            found = [(s, b + s) for b, y in arcs for s in self._both(state, y, b)]
            for k, (a, x) in enumerate(arcs):
                found += [(a + s, b + s) for b, y in arcs[k + 1:] for s in self._both(x, y, "")]
            self.known[state] = found
        return self.known[state]

    def pairs(self, before: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs that differ by one edit, with fewer than ``before`` equal letters in front of it."""
        stack = [(self.start, None, 0)] if before > 0 else []
        while stack:
            state, node, depth = stack.pop()
            edits = self._edits(state)
            if edits:
                front = _spelled(node)
                for a, b in edits:
                    yield front + a, front + b
            if depth + 1 < before:
                stack.extend((x, (node, letter), depth + 1) for letter, x in self.states[state][1].items())


def near_in_group(words: list[str], counts: list[int], short: int, low: int, high: int) -> dict[int, list]:
    """Near words of each word of a partition, as place -> [how many, -(largest n), its word].

    Words have ``short`` letters or one more, and share the letters outside of the places ``low`` to ``high``. Pairs of two
    longer words are left to the partitions of that length.
    """
    rest = max(0, short - high)
    middles = [w[low:len(w) - rest] for w in words]
    ends = [min(middles), max(middles)]
    front = len(commonprefix(ends))
    backs = [m[front:][::-1] for m in middles]
    tail = commonprefix([min(backs), max(backs)])
    # The letters behind the place of an edit tell where it is: keep the first of the tail up to an unlike one.
    keep = len(tail)
    while keep > 1 and tail[keep - 1] == tail[keep - 2]:
        keep -= 1
    cut = max(0, keep - 2)
    place = {m[front:len(m) - cut]: k for k, m in enumerate(middles)}
    found: dict[int, list] = {}
    for a, b in OneEdit(sorted(place)).pairs(high - low - front):
        i, j = place[a], place[b]
        if len(words[i]) > short:
            continue
        for x, y in ((i, j), (j, i)):
            best = (-counts[y], words[y])
            mine = found.setdefault(x, [0, *best])
            mine[0] += 1
            if best < (mine[1], mine[2]):
                mine[1:] = best
    return found


def _key(short: Column, low: Column, high: Column) -> Column:
    """Digest of all that the words of a partition have in common."""
    word, rest = F.col("word"), F.greatest(F.lit(0), short - high)
    return F.md5(F.concat_ws("|", short, low, high, F.substring(word, F.lit(1), low),
                             F.substring(word, F.length(word) - rest + 1, rest)))


def _parted(rows: DataFrame, parts: Column) -> DataFrame:
    """Rows in each of their partitions (``short``, ``low``, ``high``), with its key."""
    return rows.select("word", "n", F.inline(parts)).withColumn(
        "key", _key(F.col("short"), F.col("low"), F.col("high")))


def _part(short: Column, low: Column, high: Column) -> Column:
    return F.struct(short.alias("short"), low.alias("low"), high.alias("high"))


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, group: int = GROUP) -> DataFrame:
    """``word``, ``n_near`` and its near word of largest count (``best``: ``form_n`` negated, ``form``).

    A pair of near words has one first place in which they are unlike. Letters before it are equal, and so
    are those behind the edit, so pairs with that place in the second half of a word share the first half, and
    the others share the second half: these are the initial states by which the composition is parted,
    with the length of the shorter word. A partition with more than ``group`` words is parted again, by halves of the
    places that its words do not share, until an edit has one place left, where no more words meet than there are
    one or two letters. Hence every pair is found in exactly one partition, and none is larger than that.
    """
    size = F.length("word")
    every = F.filter(F.array(size, size - 1), lambda c: c >= min_length)
    halves = F.flatten(F.transform(every, lambda c: F.array(
        _part(c, F.lit(0), F.floor((c + 1) / 2).cast("int")), _part(c, F.floor((c + 1) / 2).cast("int"), c + 1))))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for short, low, high, members in zip(*[batch.column(c).to_pylist() for c in ("short", "low", "high", "members")]):
                names = [m["word"] for m in members]
                found = near_in_group(names, [m["n"] for m in members], short, low, high)
                rows += [(names[k], *best) for k, best in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)],
                                             schema=schema)

    active, found = _parted(words, halves), None
    while True:
        active = cut_lineage(active, "partitions")
        sizes = cut_lineage(active.groupBy("key").agg(
            F.count("*").alias("size"), F.count(F.when(F.length("word") == F.col("short"), 1)).alias("own"),
        ).where("size > 1 AND own > 0").select("key", "size"), "sizes")
        met = active.join(sizes, "key")
        hot = (F.col("size") > group) & (F.col("high") - F.col("low") > 1)
        groups = met.where(~hot).groupBy("key", "short", "low", "high").agg(
            F.collect_list(F.struct("word", "n")).alias("members"))
        here = cut_lineage(groups.select("short", "low", "high", "members").mapInArrow(
            near, "word string, n_near long, form_n long, form string"), "near")
        found = here if found is None else found.unionAll(here)
        if not sizes.where(F.col("size") > group).limit(1).count():
            break
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        finer = F.array(_part(F.col("short"), F.col("low"), middle), _part(F.col("short"), middle, F.col("high")))
        active = _parted(met.where(hot), finer)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("form_n", "form")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``word`` and the last word of its chain of ``form`` links, by doubling the links until no chain goes on.

    Counts grow at least tenfold along a chain, so chains are short and there is no circle. Each round is a written table.
    """
    links = cut_lineage(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        after = links.select(F.col("word").alias("middle"), F.col("root").alias("after"))
        longer = cut_lineage(links.join(after, F.col("root") == F.col("middle"), "left").select(
            "word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("more")), "forms")
        if not longer.where("more").limit(1).count():
            return links
        links = longer.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      one_in: int = ONE_IN, group: int = GROUP) -> DataFrame:
    """Words of all texts with the form that each is a rare variant of.

    Words (``vocabulary``) are near if one code point more, less or replaced makes one the other; near pairs come from
    composing the acceptor of the words with a one-edit transducer and the acceptor again (``near_words``). The form of a word
    is its near word of largest ``n`` (ties: the smallest) if that has at least ``ratio`` times its ``n``, else
    null; ``root`` follows forms to the last, and is the word itself without one.

    Null and empty texts have no words, a null ``doc_id`` counts as empty. Rows with equal ``doc_id`` count each. Texts are
    read whole, whatever their length. Other columns are ignored; an empty table gives no rows.
    """
    words = cut_lineage(vocabulary(docs, min_length, min_count, one_in), "words")
    near = near_words(words, min_length, group)
    form = F.when(-F.col("best.form_n") >= ratio * F.col("n"), F.col("best.form"))
    formed = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("best.form_n")).alias("form_n")), "words")
    return formed.join(roots(formed.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))
