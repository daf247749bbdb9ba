"""Operators for training text against brute force, on small tables with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import (
    boilerplate, components, encoder, idfiles, licences, packing, simhash, structural, surrogates, toxicity, weighted,
    winnow,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, start string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEY = b"key of the tests"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def long_text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n).tolist())


@pytest.fixture(scope="module")
def rows():
    base = long_text(1, 300)
    texts = [
        None, "", " \n\t ", "one", "One two THREE", base, base, base.replace("alpha", "Alpha", 1),
        base + " tail", "été Ünder İx don't 12 áb  wide <|endoftext|> x", "日本語 テキスト", "x" * 5000,
        long_text(2, 6000), "a\n\na\nb", "the same line\nother", "the same line\nmore", "the same line\nagain",
    ]
    out = [(i * 3, t, "en", "s1" if i % 3 else None, None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[5], (None, "null id", None, "s1", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encoder.word_bpe_path())
    return [np.array(x.ids + [2], "<u4") for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_by_word_ids_are_those_of_whole_texts(rows):
    texts = [r[1] for r in rows] + ["A.b, c! ÀÉ; ß: don't I'LL 'sx x's\x1cy\x85z ǅ Σς", "a" * 300 + "." * 40]
    ours = encoder.IdEncoder(encoder.word_bpe_path(), 2, remember=5)
    for _ in range(2):
        assert [x.tobytes() for x in whole_ids(texts)] == ours.encode(texts)
    assert ours.by_word


def test_packing_holds_every_id_once(docs, empty, rows):
    found = packing.pack(docs, encoder.word_bpe_path(), length=256).toPandas()
    expected = Counter()
    for r, ids in zip(rows, whole_ids([r[1] for r in rows])):
        expected[(r[0], ids.tobytes())] += 1
    got = Counter()
    for doc, group in found.groupby("doc_id", dropna=False):
        group = group.sort_values(["start", "sequence_id"])
        times = int((group.start == 0).sum())
        one = group.drop_duplicates("start") if times > 1 and group.start.duplicated().any() else group
        if one.length.sum() == one.doc_tokens.iloc[0]:
            got[(None if np.isnan(doc) else int(doc), b"".join(one["ids"]))] += times
    assert sum(found.length) == sum(len(k[1]) // 4 * n for k, n in expected.items())
    assert all(got[k] == n for k, n in expected.items() if n == 1)
    for _, seq in found.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset.values == np.r_[0, np.cumsum(seq.length.values)[:-1]]).all()
        total = seq.length.sum()
        assert total == 256 or total < 256 and total & (total - 1) == 0
    assert packing.pack(empty, encoder.word_bpe_path()).count() == 0


def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = packing.hilbert_index(cells, 3)
    assert sorted(order.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(order)], axis=0)).sum(1) == 1).all()


def test_token_files_round_trip(spark, docs, empty, rows, tmp_path):
    path = str(tmp_path / "ids")
    idfiles.write_token_files(docs, path, encoder.word_bpe_path())
    found = idfiles.read_token_files(spark, path).toPandas().sort_values("start")
    ids = {(r[0], i.tobytes()) for r, i in zip(rows, whole_ids([r[1] for r in rows]))}
    assert {(None if np.isnan(d) else int(d), np.array(x, "<u4").tobytes()) for d, x in zip(found.doc_id, found["ids"])} == ids
    assert len(found) == len(rows) and np.isnan(found.doc_id.iloc[0])
    assert (found.start.values == np.r_[0, np.cumsum(found.n_tokens.values)[:-1]]).all()
    assert (np.diff(found.doc_id.values[1:]) >= 0).all()
    crc = idfiles.with_crc32(idfiles.read_token_files(spark, path)).toPandas().sort_values("start")
    assert crc.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in found["ids"]]
    idfiles.write_token_files(empty, path + "0", encoder.word_bpe_path())
    assert idfiles.read_token_files(spark, path + "0").count() == 0


def test_token_files_encodings(docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "ids")
    idfiles.write_token_files(docs, path, encoder.word_bpe_path())
    for f in glob.glob(path + "/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        found = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in found["doc_id"].encodings
        assert any("DICTIONARY" in e for e in found["ids.list.element"].encodings)
        assert all(c.has_column_index and c.has_offset_index for c in found.values())


def brute_leaks(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((len(w), len(hit), tuple(sorted(found))))
    return out


def test_winnowing_finds_every_shared_window(spark, docs, empty, rows):
    texts = [r[1] for r in rows]
    items = [(1, " ".join(texts[5].split()[40:70])), (2, "ONE; two"), (10, long_text(2, 6000)[300:700]), (3, None), (4, ""),
             (5, " ".join(["pi"] * 14)), (6, " ".join(texts[5].split()[60:72])), (7, "日本語"), (6, "tail"), (None, "three")]
    planted = [*rows, (900, "x " + " ".join(["pi"] * 30) + " y", None, None, None, None, None, None),
               (901, "so " + items[0][1].upper() + " on", None, None, None, None, None, None)]
    frame = spark.createDataFrame(planted, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = winnow.decontaminate(frame, bench).collect()
    expected = brute_leaks([r[1] for r in planted], [i for i in items if i[0] is not None])
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found)
    assert got == Counter((p[0], *e, e[1] > 0) for p, e in zip(planted, expected))
    assert any(e[1] for e in expected)
    assert winnow.decontaminate(empty, bench).count() == 0
    assert not winnow.decontaminate(frame, bench.limit(0)).where("contaminated").count()


def test_secrets_plain_and_confirmed(spark, empty):
    def der(tag, body):
        n = len(body)
        size = bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])
        return bytes([tag]) + size + body

    number = der(2, b"\x01" + b"\x5a" * 63)
    rsa = der(0x30, der(2, b"\0") + number * 8)
    wrapped = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, rsa))
    b64 = base64.b64encode(rsa).decode()
    broken = base64.b64encode(rsa[:-3] + b"\0").decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256'})}.{part({'sub': 'x'})}.abc_DEF"
    texts = {
        1: f'é password: token: abcdef tOken="abcdef12" {b64} end', 2: f"x {broken} y", 3: f"say {jwt}.", 4: f"{part({'a': 1})}.{part({})}.zz",
        5: "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(wrapped).decode() + "-----END PRIVATE KEY-----",
        6: "hex " + wrapped.hex(), 7: "AKIA" + "A1" * 8 + " AKIA12", 8: None, 9: "", 10: "0" * 40 + "ſecret=abcdef",
    }
    frame = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in structural.find_secrets(frame).collect()}
    kinds = {k: [s[0] for s in v] for k, v in found.items()}
    assert kinds[1] == ["assign", "key"] and kinds[2] == [] and kinds[3] == ["jwt"] and kinds[4] == []
    assert kinds[5] == ["pem"] and kinds[6] == ["hex", "key"] and kinds[7] == ["access"]
    assert kinds[8] == kinds[9] == [] and kinds[10] == ["hex"]
    for k, spans in found.items():
        for kind, a, b in spans:
            assert {"assign": 'tOken="abcdef12', "key": b64 if k == 1 else wrapped.hex(), "jwt": jwt + "."}.get(
                kind, texts[k][a:b]).rstrip(".") == texts[k][a:b].rstrip(".")
    assert structural.find_secrets(empty).count() == 0


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 + (n := (size.bit_length() + 7) // 8)]) + size.to_bytes(n, "big")
    return bytes([tag]) + head + body


def plain_reading(text):
    """Base spans by the contract, kind by kind."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_secrets_against_a_plain_reading(spark, docs, empty, rows, tmp_path):
    rng = np.random.default_rng(8)
    pieces = ["password=", "Token : ", "api_key='", "APIKEY:", "secret", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef" * 4, "0123456789abcdef" * 3,
              " ", "\n", "x", "é", "🔑", "short", "longer-value", "\x20\x20=", '"', "a" * 23, "f" * 24]
    texts = ["".join(rng.choice(pieces, 30).tolist()) for _ in range(300)] + [None, "", "password=" + "z" * 200_000]
    given = [(i, t, "en", "s", None, "c", "c", "c") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(given + given[:5], SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = structural.secret_spans(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in given + given[:5])
    for r in found:
        base = plain_reading(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == base
    assert structural.find_secrets(empty).count() == 0 and structural.find_secrets(docs).count() == len(rows)


def test_every_structure_of_a_key_is_confirmed():
    number = lambda n: der(2, bytes(range(1, n + 1)))
    rsa = der(0x30, der(2, b"\0"), number(64), number(3), *[number(32)] * 6)
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, bytes.fromhex("2a864886f70d010101"))), der(4, rsa))
    scheme = der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, number(8)))
    sealed = der(0x30, scheme, der(4, bytes(64)))
    curve = der(0x30, der(2, b"\1"), der(4, bytes(range(32))))
    wrap = lambda raw: "\n".join(re.findall(".{1,64}", base64.b64encode(raw).decode()))
    pem = lambda label, raw, head="": f"-----BEGIN {label}-----\n{head}{wrap(raw)}\n-----END {label}-----"
    one_line = lambda raw: base64.b64encode(raw).decode()
    token = lambda head: ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (
        head, b'{"sub": "x"}', b"signature"))
    cases = {
        "pem": [pem("PRIVATE KEY", pkcs8), pem("ENCRYPTED PRIVATE KEY", sealed), pem("RSA PRIVATE KEY", rsa),
                pem("PRIVATE KEY", pkcs8).replace("\n", "\\n"), pem("PRIVATE KEY", pkcs8).replace("\n", "\r\n"),
                pem("RSA PRIVATE KEY", bytes(range(128)), "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n")],
        "key": [one_line(rsa), one_line(curve), one_line(sealed), one_line(pem("PRIVATE KEY", pkcs8).encode()), wrap(rsa),
                "vault/path/" + one_line(curve), rsa.hex(), curve.hex().upper(), base64.urlsafe_b64encode(rsa).decode().rstrip("=")],
        "jwt": [token(b'{"alg": "HS256"}'), token(b'{ "alg": "HS256"}'), token(b' {"alg":"none"}'), token(b'{\r\n "alg":"RS256"}')],
    }
    for kind, texts in cases.items():
        for text in texts:
            found = structural.confirmed_spans(f"é {text} end")
            assert [k for k, *_ in found] == [kind], (kind, text[:60], found)
            a, b = found[0][1:]
            assert f"é {text} end"[a:b] == text.removeprefix("vault/path/")
    for text in (one_line(rsa[:-1]), one_line(rsa + b"x"), one_line(bytes(range(200))), pem("PRIVATE KEY", bytes(64)), "a.b.c", rsa.hex()[:-2],
                 pem("RSA PRIVATE KEY", bytes(range(127)), "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"),
                 token(b'{"typ": "JWT"}'), one_line(der(0x30, der(0x30, der(6, bytes.fromhex("2b0601"))), der(4, bytes(40))))):
        assert structural.confirmed_spans(f"x {text} y") == []


def test_site_lines(spark, docs, empty, rows):
    frame = spark.createDataFrame(
        [(i, f"menu\nmenu\n\nbody {i}\nrare" if i < 4 else f"body {i}", "en", "a", 1) for i in range(20)]
        + [(50, "menu\nx", "en", None, 1), (51, None, "en", "a", 1), (52, "menu", "en", "a", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: (r.text, r.n_dropped) for r in boilerplate.drop_site_lines(frame, ratio=0.2).collect()}
    assert found[0] == ("\nbody 0\nrare", 2) and found[5] == ("body 5", 0)
    assert found[50] == ("menu\nx", 0) and found[51] == (None, 0) and found[52] == ("", 1)
    assert boilerplate.drop_site_lines(empty).count() == 0
    assert boilerplate.drop_site_lines(docs).count() == len(rows)
    old, boilerplate.BROADCAST_LINES = boilerplate.BROADCAST_LINES, -1
    try:
        again = {r.doc_id: (r.text, r.n_dropped) for r in boilerplate.drop_site_lines(frame, ratio=0.2).collect()}
    finally:
        boilerplate.BROADCAST_LINES = old
    assert again == found
    clash = frame.withColumns({n: F.lit("clash") for n in ("_host", "_known", "n_dropped", "found_0", "host", "known", "key", "c", "p")})
    out = boilerplate.drop_site_lines(clash, ratio=0.2)
    assert sorted(out.columns) == sorted(clash.columns)
    assert {r.doc_id: (r.text, r.n_dropped) for r in out.collect()} == found and {r._host for r in out.collect()} == {"clash"}


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = dict(enumerate(prints))
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in parent:
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in parent]


def test_simhash_components(docs, empty, rows):
    found = sorted((r.fingerprint, r.component_id) for r in simhash.similar_fingerprints(docs).collect())
    prints = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(prints)
    least = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    assert found == sorted(((f"{p:016x}", least.get(c)) for p, c in zip(prints, comp)), key=lambda x: (x[0], x[1] is None, x[1])) \
        or Counter(found) == Counter((f"{p:016x}", least.get(c)) for p, c in zip(prints, comp))
    assert simhash.similar_fingerprints(empty).count() == 0


def test_position_links_join_all_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    values = set(base.tolist())
    for b in base.tolist():
        for _ in range(120):
            v = b
            for k in rng.integers(0, 20 if _ % 2 else 64, rng.integers(1, 5)).tolist():
                v ^= 1 << k
            values.add(v)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = {r.node: r.root for r in components.components(simhash.position_links(frame)).collect()}
    comp = brute_components([v & (1 << 64) - 1 for v in values])
    assert [found.get(v, v) for v in values] == [values[min(k for k in range(len(values)) if comp[k] == c)] for c in comp]


def test_long_lists_are_linked_by_lookup():
    rng = np.random.default_rng(4)
    low = rng.choice(1 << 16, 3000, replace=False).astype(np.int64)
    members = (low & 255) | (low >> 8 << 40) | (7 << 48)
    a, b = simhash.link_list(members, 2)
    values = np.sort(members)
    near = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= 2
    root = np.arange(len(values))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(values))])
        if (new == root).all():
            break
        root = new
    expected = dict(zip(values.tolist(), values[root].tolist()))
    got = dict(zip(a.tolist(), b.tolist()))
    assert {v: got.get(v, v) for v in values.tolist()} == expected


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (200, 200)], "src long, dst long")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark, docs, empty, rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    best = {}
    for k, (r, c) in enumerate(zip(rows, brute_components(prints))):
        best.setdefault(c, []).append((r[0] is None, r[0] or 0, k))
    expected = Counter(rows[min(found)[2]][:2] for found in best.values())
    clash = docs.withColumns({n: F.lit("clash") for n in ("own_0", "other_0", "digest", "fingerprint", "root", "n")})
    found = simhash.one_of_each(clash)
    assert found.columns == clash.columns
    assert Counter((r.doc_id, r.text) for r in found.collect()) == expected
    assert simhash.one_of_each(empty).count() == 0
    same = spark.createDataFrame([(1, "x y z w"), (1, "x y z w"), (1, "other text of one id"), (None, "x y z w"), (2, None), (3, "")],
                                 "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(same).collect()), key=str) == sorted(
        [(1, "x y z w"), (1, "other text of one id"), (2, None)], key=str)


def test_weighted_sampling(docs, empty, rows):
    found = weighted.fingerprint_edits(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in order]
    assert len(found) == len(rows)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found)
    expected = Counter()
    for k, (r, t) in enumerate(zip(order, texts)):
        n, following = len(t) // 4, texts[(k + 1) % len(texts)]
        expected[(r[0], len(t), hashlib.sha256((t[:len(t) - n] + following[:n]).encode()).hexdigest())] += 1
    assert got == expected
    by_text = {}
    for r in found:
        by_text.setdefault({x[0]: x[1] for x in rows}[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[None] == by_text[""] == {""}
    assert weighted.fingerprint_edits(empty).count() == 0
    lone = weighted.fingerprint_edits(docs.where("doc_id = 12")).first()
    assert lone.near_next == 1.0


def test_sampling_rate_is_generalised_jaccard(spark):
    rng = np.random.default_rng(6)
    pairs, exact = [], []
    for k in range(150):
        # Words of its own for each pair: samples of one word are the same everywhere, so errors would not be independent.
        own = [f"{w}{k}" for w in WORDS]
        a, b = Counter(rng.choice(own, 60).tolist()), Counter(rng.choice(own[:12], 60).tolist())
        pairs += [(2 * k, " ".join(a.elements())), (2 * k + 1, " ".join(b.elements()))]
        exact.append((a & b).total() / (a | b).total())
    found = {r.doc_id: r.near_next for r in weighted.fingerprint_edits(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    error = np.array([found[2 * k] - x for k, x in enumerate(exact)])
    assert abs(error.mean()) < 0.03 and error.std() < 0.12


def test_toxicity_learns_gapped_insults(spark, empty):
    rng = np.random.default_rng(7)
    good, bad, dirty = WORDS, ["dreckig", "miststueck"], []
    for i in range(600):
        words = rng.choice(good, 40).tolist()
        toxic = i % 4 == 0
        if toxic:
            words.insert(int(rng.integers(40)), bad[i // 4 % 2])
        dirty.append((i, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(dirty, "doc_id long, text string, toxic long")
    model = toxicity.train(frame.drop("toxic"), frame.drop("text"))
    found = {r.doc_id: r.score for r in toxicity.score(frame.withColumn("score", F.lit(9)), model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(found[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    tests = [(1, "alpha d-r-e-c-k-i-g beta"), (2, "so drexckig it is"), (3, "d r e c k i g you"), (4, "alpha beta"),
             (5, None), (6, ""), (7, "x" * 100_000), (8, "alpha. " * 20_000 + "miststueck"), (9, "you dxrxexcxkxixg one"),
             (10, "a dr eckig beta"), (11, "so drecki g. it")]
    scores = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert all(scores[i] >= 0.5 for i in (1, 2, 3, 8, 9, 10, 11)) and all(scores[i] < 0.5 for i in (4, 5, 6, 7))
    kept = toxicity.keep_clean(spark.createDataFrame(tests, "doc_id long, text string"), model)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    assert toxicity.train(frame.drop("toxic"), frame.drop("text").limit(0)) is None
    assert {r.score for r in toxicity.score(frame.drop("toxic"), None).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def brute_kernel(s, t, p, decay):
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), p):
        for b in combinations(range(len(t)), p):
            if [s[i] for i in a] == [t[j] for j in b]:
                total += decay ** (a[-1] - a[0] + b[-1] - b[0] + 2)
    return total


def test_subsequence_kernel_is_the_sum_over_pairs():
    for word in ("idiot", "i-d1ot", "tooidi", "xx", "clowning"):
        for landmark in ("idiot", "clown", "scum"):
            p = toxicity.order_of(landmark)
            assert np.isclose(toxicity.subsequence_kernel(toxicity.codes([word, "padpadpad"]), landmark)[0],
                              brute_kernel(word, landmark, p, toxicity.DECAY))


def test_margin_of_a_text_is_that_of_its_worst_sentence():
    """The Nyström map and the machine, written out from the kernel."""
    marks = toxicity.Landmarks(["idiot", "clown", "scum", "trash"])
    own = [brute_kernel(w, w, toxicity.order_of(w), toxicity.DECAY) for w in marks.words]

    def share(word, k):
        landmark = marks.words[k]
        value = brute_kernel(word, landmark, toxicity.order_of(landmark), toxicity.DECAY) / own[k]
        return min(value, 1.0) if value >= toxicity.CUT and len(set(landmark) - set(word)) <= 1 else 0.0

    gram = np.array([[share(w, k) for k in range(4)] for w in marks.words])
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 0.05 * np.eye(4))
    onto = vector @ np.diag(np.maximum(value, 0.05) ** -0.5) @ vector.T
    weights = np.array([1.5, 0.25, -0.5, 2.0, -1.0])
    model = toxicity.Model(marks, weights, 2.0, 0.5, frozenset({"a", "the"}))
    texts = ["The idi0t spoke. A clown and some trash!", "nothing here", "", "scumm; ttrash", "id iot. Claun", "t.r.a.s.h", "tXrXaXsXh"]
    words = [[["idi0t", "spoke", "the"], ["clown", "and", "some", "trash"]], [["nothing", "here"]], [[]], [["scumm", "ttrash"]],
             [["idiot"], ["claun"]], [["trash"]], [["trash"]]]
    expected = []
    for sentences in words:
        best = weights[-1]
        for s in sentences:
            x = np.array([max([share(w, k) for w in s], default=0.0) for k in range(4)])
            if x.any():
                best = max(best, x @ onto @ weights[:-1] + weights[-1])
        expected.append(best)
    found = model.margins(model.reader().sentences(texts))
    assert np.allclose(found, expected) and np.allclose(model.scores(found), 1 / (1 + np.exp(-(2 * np.array(expected) + 0.5))))


def test_surrogates(spark, empty):
    texts = {
        1: "Mail Ann.Lee@corp.com or ann.lee@corp.com, call +1 (017) 555-7713 from 10.20.30.40; Mrs. Maria Keller met Frau Keller",
        2: "Again +1 (017) 555-7713 and 1017 555 7713, card 4539578763621486, mail bo@x.org; Г-н Иван Петров",
        3: None, 4: "", 5: "version 1.2.3.4.5 and 99", 6: "IBAN DE89370400440532013000.",
    }
    frame = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    found = {}
    for r in surrogates.replace_entities(frame, KEY).collect():
        assert found.setdefault(r.doc_id, (r.text, r.n_entities)) == (r.text, r.n_entities)
    one, two = found[1][0], found[2][0]
    for gone in ("lee@", "555-7713", "10.20.30.40", "Maria", "Keller"):
        assert gone not in one
    phone = re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", one)[0]
    assert phone in two and found[1][1] == 7
    digits = re.sub(r"\D", "", phone)
    assert f"{digits[0]}{digits[1:4]} {digits[4:7]} {digits[7:]}" in two
    mails = re.findall(r"[\w.]+@[\w.]+\w", one)
    assert len(set(m.lower() for m in mails)) == 1
    family = re.search(r"Mrs\. (\w+) (\w+) met Frau (\w+)", one)
    assert family[2] == family[3] and family[1].endswith(("a", "e"))
    assert re.search(r"Г-н [А-Я][а-я]+ [А-Я][а-я]+", two) and "Петров" not in two
    card = re.search(r"card (\d{16})", two)[1]
    assert card != "4539578763621486" and surrogates.luhn(card)
    assert found[3] == (None, 0) and found[4] == ("", 0) and found[5] == (texts[5], 0)
    iban = re.search(r"DE\d{20}", found[6][0])[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert surrogates.replace_entities(empty, KEY).count() == 0


def test_surrogates_stay_distinct(spark):
    names = [f"Mr. {a}{b}" for a in ("Ba", "Do", "Ki", "Lu", "Mo") for b in ("den", "lar", "mir", "nox", "pel", "qui", "rus", "tan")]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names * 2)], "doc_id long, text string")
    found = {}
    for r in surrogates.replace_entities(frame, KEY).collect():
        found.setdefault(names[r.doc_id % len(names)], set()).add(r.text)
    assert all(len(v) == 1 for v in found.values())
    assert len({next(iter(v)) for v in found.values()}) == len(names)
    assert not {next(iter(v)) for v in found.values()} & set(names)


def test_many_more_names_than_the_first_lists_hold(spark):
    ab = "abcdefghijklmnopqrstuvwxyz"
    rows = [("name", "name-s", f"{a}{b}{c}x") for a in ab for b in ab for c in ab]
    rows += [("name", "name-f", f"{chr(1072 + i % 32)}{chr(1072 + i // 32 % 32)}{chr(1072 + i // 1024)}ж") for i in range(8000)]
    rows += [("digits", "phone", f"{i:05d}0") for i in range(0, 100_000, 20)]
    attempts = {(r.form, r.entity): r.attempt for r in surrogates.assign(
        spark.createDataFrame(rows, "form string, kind string, entity string"), KEY).collect()}
    made = {(f, surrogates.surrogate(k, e, attempts.get((f, e), 0), KEY)) for f, k, e in rows}
    assert len(made) == len(rows) and not made & {(f, e) for f, _, e in rows}


def test_one_surrogate_for_all_writings_of_an_entity(spark):
    """Brute force over mentions: equal canonical forms, equal surrogates; unlike forms, unlike ones."""
    texts = [
        "Dr Anna Smith spoke. Mrs Anna Smith left. Dr. Anna came.", "Prof Smith and Herr Dr Smith; Ms Anna Lee",
        "call +14155550123 or 1 415 555 0123 or 14155550123", "card 4539 5787 6362 1486, card 4539578763621486, 4539-5787-6362-1486",
        "DE89 3704 0044 0532 0130 00 and DE89370400440532013000", "ann@x.com ANN@X.COM", "Mr Kim Park. Frau Kim Park", None, "",
        "Mr Anna Oldman", "x " * 60_000 + "Mrs Anna Smith " + "y " * 60_000 + "+1 415 555 0123",
    ]
    clash = ["clash"] * 6
    frame = spark.createDataFrame([(i, t, *clash) for i, t in enumerate(texts * 2)],
                                  "doc_id long, text string, digest string, again string, kind string, entity string, form string, value string")
    found = [r for r in surrogates.replace_entities(frame, KEY).collect()]
    values: dict = {}
    for r in found:
        old = texts[r.doc_id % len(texts)]
        if not old:
            assert (r.text, r.n_entities) == (old, 0)
            continue
        spans, shift = surrogates.entities(old), 0
        assert r.n_entities == len(spans)
        for k, (a, b, kind, entity) in enumerate(spans):
            end = spans[k + 1][0] if k + 1 < len(spans) else len(old)
            behind = old[b:end]
            stop = r.text.index(behind, a + shift) if behind else len(r.text)
            new = r.text[a + shift:stop]
            values.setdefault((surrogates.form_of(kind), entity), set()).add(surrogates.canonical(kind, new))
            shift = stop - b
    assert all(len(v) == 1 for v in values.values())
    assert len({(f, *v) for (f, _), v in values.items()}) == len(values)
    assert not {(f, *v) for (f, _), v in values.items()} & set(values)
    assert next(iter(values[("name", "anna")])).endswith(("a", "e")), "two texts call Anna a woman, one a man"
    assert {f for f, _ in values} == {"name", "digits", "iban", "email"}
    other = {r.doc_id: r.text for r in surrogates.replace_entities(frame, b"another key").collect()}
    assert other[0] != next(r.text for r in found if r.doc_id == 0)
    with pytest.raises(TypeError):
        surrogates.replace_entities(frame)


def test_surrogates_of_bare_numbers_and_later_mentions():
    for phone in ("+14155550123", "+4915112345678", "+49 15112345678"):
        text = f"call {phone} now"
        assert [(text[a:b], k) for a, b, k, _ in surrogates.entities(text)] == [(phone, "phone")]
    text = "Smith-Jones and Smithers met Mr John Smith's friend. SMITH said: John Smith, smith. Prof. Dr. Ada Byron; Byron's"
    found = [(text[a:b], k, e) for a, b, k, e in surrogates.entities(text)]
    assert found == [("John", "name-m", "john"), ("Smith", "name-s", "smith"), ("SMITH", "name-s", "smith"),
                     ("John", "name-m", "john"), ("Smith", "name-s", "smith"), ("Ada", "name-n", "ada"),
                     ("Byron", "name-s", "byron"), ("Byron", "name-s", "byron")]


def test_licences(spark, docs, empty, rows):
    mit, third = licences.TEMPLATES["MIT"], licences.TEMPLATES["BSD-3-Clause"]
    texts = {
        1: "code\n" + mit + "\nmore text here", 2: "x\nThis project is released under the MIT license for all.\ny",
        3: "Released under another sort of contract that has many more words than a notice", 4: None, 5: "",
        6: "Licensed under the Apache License, Version 2.0.", 7: "word " * 5000,
        8: "in one line " + " ".join(mit.split()) + " and " + " ".join(third.split()) + " end",
        9: "Copyright (c) 2020 X. ALL RIGHTS\nreserved, İ.", 10: "w " * 100_000 + licences.TEMPLATES["GPL-2.0"].replace("useful", "helpful"),
    }
    frame = spark.createDataFrame([(i, t, *["clash"] * 5) for i, t in [*texts.items(), (1, texts[1])]],
                                  "doc_id long, text string, name string, start string, end string, dice string, licences string")
    found = {}
    for r in licences.find_licences(frame).collect():
        got = [(x.name, texts[r.doc_id][x.start:x.end]) for x in r.licences]
        assert found.setdefault(r.doc_id, got) == got
    assert found[1] == [("MIT", mit[:-1])] and found[2] == [("MIT-notice", "released under the MIT license")]
    assert found[6] == [("Apache-2.0-notice", texts[6][:-1])] and found[9] == [("All-rights-reserved", "ALL RIGHTS\nreserved")]
    assert [n for n, _ in found[8]] == ["MIT", "BSD-3-Clause"] and [n for n, _ in found[10]] == ["GPL-2.0"]
    assert found[3] == found[4] == found[5] == found[7] == []
    assert licences.find_licences(empty).count() == 0 and licences.find_licences(docs).count() == len(rows)
    assert licences.Matcher({"none": "word", "empty": ""}, 0.8).passages("word word") == []


def test_licence_bounds_lose_nothing():
    rng = np.random.default_rng(8)
    words = ["a", "b", "c", "d", "e", "x"]
    template = {"t": "a b c d e a c e b d"}
    own = licences.bigrams(licences.normal_words(template["t"]))
    matcher = licences.Matcher(template, 0.6)
    some = 0
    for _ in range(900):
        text = rng.choice(words, rng.integers(1, 40)).tolist()
        every = {(i, j): licences.dice(licences.bigrams(text[i:j]), own) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
        found = matcher.passages(" ".join(text))
        assert bool(found) == (max(every.values()) >= 0.6)
        some += bool(found)
        # Single letters: word k is at place 2 k.
        for _, a, b, value in found:
            assert np.isclose(every[a // 2, b // 2 + 1], value) and value >= 0.6
        for (i, j), value in every.items():  # what is not reported overlaps something that is
            assert value < 0.6 or any(2 * i < b and a < 2 * j for _, a, b, _ in found)
    assert some > 50
