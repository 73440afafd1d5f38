"""Periodic runs, source divergence and prefix tokens: brute force, the library, and the defined cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gitstrata.llm import divergence_audit, period_runs, prefix_tokens, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, node string, ids string, shard int, octave string, n string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    """Rows ``(doc_id, text, lang, source)`` with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", 3, "z", "w") for r in rows], SCHEMA).repartition(5)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


# Periodic runs


def brute_runs(doc_id, text):
    """All runs by comparing every word with the one a period later, for every period."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    known, best = {}, {}
    codes = np.array([known.setdefault(x, len(known)) for x in w])
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (codes[:-q] == codes[q:]).astype(int), [0]])
        edges = np.flatnonzero(np.diff(same)).tolist()
        for first, end in zip(edges[::2], edges[1::2], strict=True):
            if end - first + q >= max(6, 4 * q):
                best.setdefault((first, end - first + q), q)
    runs = sorted((first, q, length) for (first, length), q in best.items())
    gone = np.zeros(n, bool)
    for first, q, length in runs:
        gone[first + q : first + length] = True
    top = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else None
    longest = (top[0], top[2], top[1], top[2] * 1000 // top[1]) if top else (None,) * 4
    listed = "".join(f"{a},{b},{q}\n" for a, q, b in runs)
    return doc_id, len(runs), *longest, sha(listed), sha(" ".join(x for x, k in zip(w, gone, strict=True) if not k))


def periodic_texts():
    rng = random.Random(7)
    out = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x " * 22000, "a b c " * 700 + "d " + "a b c " * 500]
    for _ in range(150):
        text = []
        while len(text) < rng.choice([20, 100, 400, 900]):
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 17, 40, 70]))]
            text += (unit * rng.randrange(1, 9))[: rng.randrange(1, 400)]
            text += [rng.choice("abcdefgh") for _ in range(rng.choice([0, 0, 3, 8]))]
        out.append(rng.choice([" ", "\n", "\t "]).join(text))
    unit = [f"w{rng.randrange(500)}" for _ in range(4099)]
    return [*out, " ".join((unit * 5)[: 4 * 4099 + 7])]


def test_runs_agree_with_brute_force(spark):
    rows = list(enumerate(periodic_texts()))
    rows += [(None, "p q " * 30), (None, "p q r " * 30), (5, "dup " * 7), (5, "dup " * 7), (rows[8][0], "tie " * 22000)]
    got = period_runs.report(frame(spark, [(*r, "en", "s") for r in rows])).collect()
    assert ordered(got) == ordered(brute_runs(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 80
    # The same with the tiles of all but the shortest documents dealt out.
    assert ordered(period_runs.report(frame(spark, [(*r, "en", "s") for r in rows]), far=50).collect()) == ordered(got)


def test_runs_over_a_table(spark, sf):
    got = queries.QUERIES["op11_period_runs"](spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert ordered(got) == ordered(brute_runs(*r) for r in rows)
    assert period_runs.report(frame(spark, [])).count() == 0


def test_runs_cross_tiles_and_octaves():
    for period in (1, 2, 7, 31, 32, 33):
        codes = np.tile(np.arange(period), 5)
        octave = 1 << (period.bit_length() - 1)
        marks = np.arange(0, len(codes) - 2 * octave, octave)
        assert (period, 0, 4 * period) in period_runs.fragments(codes, marks, octave)
    assert period_runs.z_function(list("aabaab")) == [6, 1, 0, 3, 1, 0]
    # Multiples of a smaller period are no periods of their own.
    assert not period_runs.fragments(np.zeros(200, int), np.arange(0, 100, 8), 8)


# Source divergence


def audited(docs, rows):
    connection = duckdb.connect()
    table = pa.table({c: pa.array([r[i] for r in rows], pa.string()) for i, c in ((1, "text"), (2, "lang"), (3, "source"))})
    connection.register("documents", table)
    expected = connection.execute(queries.ORACLE["op12_divergence_audit"]).fetchall()
    assert ordered(divergence_audit.audit(docs).collect()) == ordered(expected)
    return expected


def test_audit_agrees_with_sql(spark):
    rng = random.Random(3)
    vocabulary = ["Äpfel", "don", "T", "the", "x", "ß", "İ", "long" * 40, *[f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(vocabulary) + rng.choice(" .,'-\n0") for _ in range(rng.choice([0, 1, 5, 60, 300])))
        rows.append((i % 250 or None, text, rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None])))
    rows += [rows[7], rows[7], (1, None, "en", "silent"), (2, "9 8 7", "xx", "only"), (3, "one two", "yy", "a"), (4, "THE " * 20000, "en", "s2")]
    rows += [(5, "three", "yy", "b"), (6, "hot " * 50, "en", "hot")] + [(7 + i, "hot same words", "en", "hot") for i in range(200)]
    expected = audited(frame(spark, rows), rows)
    parts = {(r[0], r[2]) for r in expected}
    assert ("yy", "pair") in parts and ("yy", "term") not in parts and not any(r[0] == "xx" for r in expected)
    assert any(r[1] == "silent" and r[2] == "pair" for r in expected) and not any(r[1] == "silent" and r[2] == "term" for r in expected)
    assert divergence_audit.audit(frame(spark, [])).count() == 0


def test_runs_of_postings_spill_and_merge(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") * rng.randrange(1, 9) for _ in range(200)), rng.choice(["en", "de"]), f"s{i % 4}") for i in range(120)]
    docs = frame(spark, rows)
    whole = ordered(divergence_audit.frequencies(docs).collect())
    chunks = divergence_audit.index_runs(docs, block_bytes=1 << 14, chunk=5, shards=2).collect()
    assert len(chunks) > 400 and all(r.terms == sorted(r.terms) and r.first == r.terms[0] and len(r.terms) <= 5 for r in chunks)
    table = {c: pa.array([x for r in chunks for x in r[c + "s" if c != "docs" else c]]) for c in ("term", "source", "count", "docs")}
    whole_table, ends = pa.table(table), np.cumsum([len(r.terms) for r in chunks])
    opened = sorted(((r.lang, r.first, int(e)) for r, e in zip(chunks, ends, strict=True)), key=lambda r: r[:2])
    size = {int(e): len(r.terms) for r, e in zip(chunks, ends, strict=True)}
    blocks = list(divergence_audit.merged(((lang, first, whole_table.slice(e - size[e], size[e])) for lang, first, e in opened), most=300))
    assert len(blocks) > 20
    rows = [row for lang, block in blocks for row in divergence_audit.kept(lang, block, 3).to_pylist()]
    assert [(r["lang"], r["term"], r["total"], [(p["source"], p["count"]) for p in r["postings"]]) for r in rows] == [
        (r[0], r[1], r[2], [tuple(p) for p in r[3]]) for r in whole
    ]


def test_audit_holds_large_counts(spark):
    df = spark.createDataFrame([(10**15, 3 * 10**15, 10**6)], "c long, n long, v long")
    from pyspark.sql import functions as F

    got = df.select(divergence_audit.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first().p
    assert got == 1 + 10**9 * (10**15 + 1) // (3 * 10**15 + 10**6)


# Prefix tokens


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)


def hard_texts():
    rng = random.Random(1)
    pieces = prefix_tokens.Pieces.of(MODEL)
    letters = "aaabbeinthos  \n中ア🙂éÄ1234.,-▁ x\r\x7f�\0"
    out = ["hello  world\n\n x ", " a", "▁a b", "\t\0é中ア🙂 <s> <0x0A> </s>", "", " ", "  ", None, "word" * 5000, "a" * 20000, "x " * 22000]
    out += [" " * k + "x" + " " * j for k in range(40) for j in (0, 3, 15, 17, 40)]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    return out + ["".join(rng.choice(pieces.texts[259 : pieces.n]) for _ in range(rng.randrange(30))) for _ in range(3000)]


def test_tokens_agree_with_the_library(spark, library):
    rows = [(i, t, None, None) for i, t in enumerate(hard_texts())]
    docs = frame(spark, [*rows, (None, "no id", None, None), rows[0], rows[0]])
    got = prefix_tokens.report(docs, MODEL).collect()
    expected = []
    for i, t in [(r[0], r[1]) for r in [*rows, (None, "no id"), rows[0], rows[0]]]:
        ids = library.encode(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert ordered(got) == ordered(expected)
    assert prefix_tokens.report(frame(spark, []), MODEL).count() == 0


def test_tokens_over_a_table(spark, sf, library):
    got = queries.QUERIES["op13_prefix_tokens"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {
        i: (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in texts.items() for ids in [library.encode(t)]
    }


def test_decode_any_ids(spark, library):
    rng = random.Random(2)
    many = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2, 28705, 259]) for _ in range(rng.randrange(8))] for _ in range(4000)]
    df = spark.createDataFrame([(i, ids) for i, ids in enumerate([*many, None])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in prefix_tokens.decode(df, MODEL).collect()}
    assert got == {i: library.decode(ids) for i, ids in enumerate([*many, []])}
    with pytest.raises(Exception, match="outside the vocabulary"):
        prefix_tokens.decode(df.limit(1).selectExpr("doc_id", "array(32000) AS ids"), MODEL).collect()


def test_fit_is_what_merging_says():
    rng = random.Random(9)
    pieces = prefix_tokens.Pieces.of(MODEL)
    tokens = sorted(pieces.token.values())
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if (pieces.size[a] == 1 or a in pieces.parts) and (pieces.size[b] == 1 or b in pieces.parts):
            assert pieces.fit(a, b) == (pieces.merged(pieces.texts[a] + pieces.texts[b])[0] == [a, b])
