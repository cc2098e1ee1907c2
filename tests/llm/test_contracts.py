"""Queries that SQL does not express, whole tables, against plain Python versions of what they must return."""

import base64
import hashlib
import re
from collections import defaultdict

import pytest

from aforo.llm import mixing, secrets, warc

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def shares(sizes):
    """The target of each source: shares by weight, what exceeds twice a source's size given to the others again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return target


def test_mixing_targets(spark):
    docs = documents(spark)
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    per = defaultdict(int)
    for d in docs:
        per[d.source] += size[d.doc_id]
    target = shares(per)
    source = {d.doc_id: d.source for d in docs}
    got = mixing.op3_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = defaultdict(int)
    for r in got:
        own = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], per[own]) and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[own], rel=1e-9)
        taken[own] += r.taken
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in target)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000}, {"a": 1, "b": 1, None: 900, "c": 50, "d": 7}, {None: 5}])
def test_targets_of_small_sources_go_to_the_others(spark, sizes):
    rows = [(i, s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).select("source", "target").distinct().collect()
    assert {r.source: pytest.approx(r.target, rel=1e-9) for r in got} == shares(sizes)


def test_archive_rows(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    payload = {p.page_id: (p.html or "").encode() for p in pages}
    first = {}
    for page in sorted(payload):
        first.setdefault(payload[page], page)
    want = {}
    for page, data in payload.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = first[data] != page
        want[page] = (len(data), digest, "revisit" if again else "response", first[data] if again else None)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op4_warc(spark, SF).collect()}
    assert got == want and len(got) == len(pages)


ANY_CASE = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
NAMES = "|".join([*map(ANY_CASE, ("password", "passwd", "secret", "token")), ANY_CASE("api") + "_?" + ANY_CASE("key")])
KINDS = [
    ("assign", re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def test_secret_rows(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in secrets.op7_secrets(spark, SF).collect()}
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        base = sorted((m.start(), k, m.end()) for k, (_, pattern, keep) in enumerate(KINDS) for m in pattern.finditer(d.text or "") if keep(m))
        listed = [f"{KINDS[k][0]}:{a}:{b}" for a, k, b in base]
        r = got[d.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if x.split(":")[0] in ("assign", "access", "hex")] == listed
        starts = [int(x.split(":")[1]) for x in spans]
        assert starts == sorted(starts)
        seen += len(base)
    assert seen
