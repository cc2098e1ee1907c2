"""Vector links, the Merkle manifest and periodic runs against brute force and SQL, on small tables with every odd case."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo.llm import merkle, oracles, periodic_runs, vector_links

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(spark, folder, name, rows, schema, files=3):
    df = spark.createDataFrame(rows, schema)
    # columns that clash with names the operators use themselves
    df = df.withColumns({c: F.lit("x") for c in ("key", "pos", "tree", "digest", "n", "bucket", "period", "start", "_row")})
    df.repartition(files).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def from_sql(folder, name, query):
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return con.execute(oracles.SQL[query]).fetchall()


def some(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# --- vectors ------------------------------------------------------------------------------------------------------


def vector_rows(dims, seed):
    rng = np.random.default_rng(seed)
    rows, n = [], 0

    def add(v, label=1, vec_id=None):
        nonlocal n
        rows.append((n if vec_id is None else vec_id, None if v is None else [None if x is None else float(x) for x in np.asarray(v, dtype=object)], label))
        n += 1

    for _ in range(60):
        add(rng.standard_normal(dims), int(rng.integers(3)))
    for k in range(3):  # near copies about the threshold, and a chain
        base = rng.standard_normal(dims)
        base /= np.linalg.norm(base)
        for _ in range(40):
            off = rng.standard_normal(dims)
            off -= base * (off @ base)
            add(base + off / np.linalg.norm(off) * rng.uniform(0.02, 0.3), k)
        step = rng.standard_normal(dims)
        step /= np.linalg.norm(step)
        for j in range(8):
            add(math.cos(0.15 * j) * base + math.sin(0.15 * j) * step, k)
    base = np.round(rng.standard_normal(dims), 3)
    for _ in range(50):  # equal ones, and one that is longer
        add(base, 2)
    add(base * 7, 2)
    add(base, None)
    add(base, 1)
    add([0.0] * dims), add(None), add([]), add([*base[:-1], None], 2), add([*base[:-1], float("nan")], 2), add([*base[:-1], float("inf")], 2)
    add(list(base) + [0.0], 2), add(base * 1e-300, 2), add(base * 1e300, 2)
    rows.append((None, [float(x) for x in base], 2))
    rows.append((3, [float(x) for x in base], 2))  # another row's id
    return rows


def brute_links(rows, threshold=0.98):
    units = []
    for vec_id, v, label in rows:
        good = vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / max(abs(y) for y in v) if good else None
        units.append(x / np.linalg.norm(x) if good else None)
    near = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and rows[i][2] == rows[j][2] and float(units[i] @ units[j]) >= threshold] for i in range(len(rows))]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = None if vec_id is None else min(rows[j][0] for j in seen)
        out.append((vec_id, len(near[i]), least, vec_id == least))
    return out


@pytest.mark.parametrize("dims, small, tile", [(64, 1024, 512), (20, 8, 8), (5, 4, 6)])
def test_all_vector_links(spark, dims, small, tile):
    rows = vector_rows(dims, dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_links.near_vectors(df, small=small, tile=tile)
    assert some(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == some(brute_links(rows))


def test_vector_query_and_sql(spark, tmp_path):
    rows = [r for r in vector_rows(16, 5) if not r[1] or all(x is None or not abs(x) > 1e30 and not 0 < abs(x) < 1e-30 for x in r[1])]
    folder = written(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    got = some(map(tuple, vector_links.op11_vector_links(spark, folder).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == some(from_sql(folder, "embeddings", "op11_vector_links")) and len(got) == len(rows)
    empty = written(spark, tmp_path / "none", "embeddings", [], "vec_id long, embedding array<float>, label int")
    assert vector_links.op11_vector_links(spark, empty).count() == 0


def test_every_cell_within_reach_is_registered():
    rng = np.random.default_rng(3)
    lattice = vector_links.Lattice(64, 0.98, 1)
    every = np.concatenate([lattice.near, -lattice.near, lattice.far, -lattice.far])
    assert len(every) == 240 + 2160
    y = rng.standard_normal((2000, 8))
    own = vector_links.decoded(y)
    rest = y - own
    assert ((rest**2).sum(1)[:, None] <= ((rest[:, None] - every[None]) ** 2).sum(2) + 1e-12).all()
    row, cell = lattice.cells(y)
    known = set(zip(row.tolist(), map(tuple, np.rint(2 * cell).astype(int).tolist())))
    assert len(known) == len(row)
    for _ in range(50):
        e = rng.standard_normal(y.shape)
        there = vector_links.decoded(y + e / np.linalg.norm(e, axis=1, keepdims=True) * vector_links._REACH)
        assert all((i, tuple(c)) in known for i, c in enumerate(np.rint(2 * there).astype(int).tolist()))


# --- trees --------------------------------------------------------------------------------------------------------


def document_rows(n, seed=0):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice("ab cé 漢 wort".split()) for _ in range(rng.randrange(30))), rng.choice(["en"] * 6 + ["de", "é", None]), rng.choice(["s1", None]), rng.choice([7, None])) for k in range(n)]
    return rows + [(1, "again", "en", "s", 5), (1, "again", "en", "s", 5), (2, None, None, None, None), (None, "no id", "en", "s", 1), (None, None, "only", None, None), (10**12, "x" * 200_000, "en", "-", 9), (-7, "", "de", "", 0)]


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def brute_proofs(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    langs = {}
    for doc_id, text, lang, source, n in rows:
        own = sha("".join(map(field, (doc_id, source, lang, n, text))))
        bad = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        langs.setdefault(lang, []).append(((doc_id is not None, doc_id), own, sha("".join(map(field, (doc_id, source, lang, n + 1, text)))) if bad else own))
    trees = {k: levels_of([x[1] for x in sorted(v)]) for k, v in langs.items()}
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    top = levels_of([trees[k][-1][0] for k in order])
    out = []
    for lang, leaves in langs.items():
        for i, ((_, doc_id), own, got) in enumerate(sorted(leaves)):
            proof = ""
            for tree, at in ((trees[lang], i), (top, order.index(lang))):
                for level in tree[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += "".join(x for j, x in enumerate(run) if j != at % 2)
                    got = sha("".join(got if j == at % 2 else x for j, x in enumerate(run)))
                    at //= 2
            out.append((doc_id, own, trees[lang][-1][0], top[-1][0], sha(proof), got, got == top[-1][0]))
    return out


@pytest.mark.parametrize("n, every", [(0, 8), (70, 1), (70, 2), (300, 3), (300, 8)])
def test_proofs_of_stored_levels(spark, n, every):
    rows = document_rows(n)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = merkle.manifest(docs, merkle.tampered_digest(), every=every).proofs()
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("p"), merkle.folded(F.col("given"), F.col("proof")).alias("f"))
    got = some(map(tuple, found.withColumn("v", F.col("f") == F.col("root")).collect()))
    assert got == some(brute_proofs(rows))


def test_merkle_query_and_sql(spark, tmp_path):
    rows = document_rows(150, 2)
    folder = written(spark, tmp_path, "documents", rows, DOCS)
    got = some(map(tuple, merkle.op12_merkle_manifest(spark, folder).collect()))
    assert got == some(brute_proofs(rows)) == some(from_sql(folder, "documents", "op12_merkle_manifest"))
    assert {r[-1] for r in got} == {True, False}
    for name, some_rows in (("none", []), ("one", rows[:1])):
        folder = written(spark, tmp_path / name, "documents", some_rows, DOCS)
        assert list(map(tuple, merkle.op12_merkle_manifest(spark, folder).collect())) == brute_proofs(some_rows)


def test_positions_of_many_ranges(spark, tmp_path):
    spark.createDataFrame([(k % 3 and "a" or "b", k // 50) for k in range(1000)], "by string, v long").repartition(7).write.parquet(str(tmp_path / "t"))
    got = merkle.positioned(spark.read.parquet(str(tmp_path / "t")), "by", "v", per_part=90).collect()
    for by in "ab":
        own = sorted((r.pos, r.v) for r in got if r["by"] == by)
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
        assert {r.n_nodes for r in got if r["by"] == by} == {len(own)}


# --- runs ---------------------------------------------------------------------------------------------------------


def brute_runs(words):
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    c, found = np.array([code[w] for w in words]), {}
    for q in range(1, len(c) // 2 + 1):
        change = np.diff(np.concatenate([[0], (c[: len(c) - q] == c[q:]).astype(np.int8), [0]]))
        for s, t in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
            if t - s + q >= max(12, 2 * q):
                found.setdefault((s, t - s + q), q)
    return sorted((s, q, n) for (s, n), q in found.items())


def run_row(doc_id, text, plant=True):
    words = [w.decode() for w in (text or "").encode().split()]
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    drop = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, q, n in runs), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def run_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            block = [rng.choice("abcdefgh" if rng.random() < 0.5 else ["x", "y", "é", "漢"]) for _ in range(rng.randrange(1, 60))]
            parts += block * rng.randrange(1, 6) + block[: rng.randrange(len(block))]
        out.append(rng.choice([" ", "\n", " \t"]).join(parts))
    return out


ODD = [None, "", " \n ", "a", "a " * 11, "a " * 12, "a\x0b" * 700, "ab " * 30 + "c", "a b " * 6, "no break " * 12, "a b c d e f a b c d e f", "a b c d e a b c d e a", ("a b b a b " * 40 + "c ") * 9]


def test_run_query(spark, tmp_path):
    texts = ODD + run_texts(150, 1)
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, ODD[6]), (3, ODD[6]), (None, ODD[-1]), (None, None)]
    folder = written(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = some(map(tuple, periodic_runs.op13_periodic_runs(spark, folder).collect()))
    assert got == some(run_row(*r) for r in rows)
    folder = written(spark, tmp_path / "none", "documents", [], "doc_id long, text string")
    assert periodic_runs.op13_periodic_runs(spark, folder).count() == 0


@pytest.mark.parametrize("tile_words", [64, 256])
def test_tiles_of_long_documents(spark, tile_words):
    rng = random.Random(tile_words)
    long = [" ".join(run_texts(12, 7 + k)) for k in range(4)] + ["z " * 3000, " ".join(str(k) for k in range(500)) + " " + " ".join(str(k % 611) for k in range(2500)), " ".join(rng.choice("ab") for _ in range(3000))]
    rows = list(enumerate(long))
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), tile_words=tile_words).collect()
    assert {r.doc_id: [(x.start, x.period, x.length) for x in r.runs] for r in got} == {k: brute_runs(t.split()) for k, t in rows}
    assert {r.doc_id: r.collapsed_sha256 for r in got} == {k: run_row(k, t, plant=False)[-1] for k, t in rows}
    assert all(sha(r.collapsed) == r.collapsed_sha256 for r in got if r.collapsed is not None)
