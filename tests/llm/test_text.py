"""Decontamination, near duplicates, passages, language-model scores and quality rules against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from aforo.llm import decontamination as dec
from aforo.llm import lm_scoring, near_dedup, quality_rules, substring_dedup
from aforo.llm.shingles import word_hashes

R = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(R.choices(VOCABULARY, k=n))


def corpus():
    passage, base = prose(70), prose(120)
    near = base.split()
    near[60] = "changed"
    chain = near[:]
    chain[20] = "again"
    docs = [(i, prose(R.randint(1, 200))) for i in range(40)]
    docs += [(100, base), (101, base), (102, " ".join(near)), (103, " ".join(chain)), (104, f"{prose(30)} {passage} {prose(40)}"), (105, f"{passage} {prose(90)}"), (106, None), (107, ""), (108, "one"), (109, "one"), (100, base), (None, "x y z"), (110, ("long " + prose(20) + " ") * 300)]
    return docs, passage


def multiset(text):
    return near_dedup.counted(near_dedup.shingle_lists(pa.array([text]), 5)[0])


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, class_id int, words string")


def test_phrases_and_neighbours(spark):
    docs, passage = corpus()
    w = passage.split()
    items = [(1, " ".join(w[5:30])), (2, "one"), (3, None), (4, "absent words"), (5, " ".join(w[40:52]).upper())]
    got = {(r.doc_id, r.n_words): r for r in dec.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    windows = {}
    for i, t in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        for k in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[k : k + 10]), set()).add(i)
    for i, t in docs:
        words, hit, found = (t or "").lower().split(), set(), set()
        for win, own in windows.items():
            for k in range(len(words) - len(win) + 1):
                if tuple(words[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= own
        r = got[(i, len(words))]
        assert (r.n_hit, r.n_items, r.contaminated) == (len(hit), len(found), bool(hit))
    assert got[(104, 140)].n_near >= 1
    assert dec.contamination(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_matches_do_not_depend_on_the_partitions(spark):
    docs, passage = corpus()
    docs += [(200, "zebra one two three quokka"), (201, "quokka " + "pad " * 40 + "zebra")]
    short = " ".join(passage.split()[20:45])
    items = spark.createDataFrame([(i, short) for i in range(4)] + [(9, "one"), (10, "quokka zebra absentword"), (11, "absentword"), (None, passage), (12, None)], "item_id long, text string")
    found = []
    for n in (1, 2, 7):
        index = dec.build_index(frame(spark, docs).select("doc_id", "text").repartition(n), shard_words=500 * n)
        found.append(sorted((str(r.doc_id), r.item, r.kind, str(r.spans)) for r in dec.matches(index, items).collect()))
    assert found[0] == found[1] == found[2]
    near = {(d, i) for d, i, kind, _ in found[0] if kind == "near"}
    assert ("200", "10") in near and ("201", "10") not in near and not any(i in ("9", "11", "12") for _, i in near)
    assert ("104", "0") in near and ("104", "0") in {(d, i) for d, i, kind, _ in found[0] if kind == "phrase"}


def test_rows_that_repeat_a_doc_id_are_judged_by_their_text(spark):
    a, b = prose(60), prose(60)
    docs = spark.createDataFrame([(5, b, 1), (100, a, 2), (100, b, 3), (100, a, 4), (None, a, 5), (None, a, 6), (7, None, 7), (7, None, 8)], "doc_id long, text string, text_hash int")
    got = Counter((r.doc_id, r.class_id, r.keep) for r in near_dedup.near_duplicates(docs).collect())
    assert got == {(5, 5, True): 1, (100, 100, True): 1, (100, 5, False): 1, (100, 100, False): 1, (None, None, True): 2, (7, 7, True): 2}
    kept = near_dedup.keep_one(docs).collect()
    assert len(kept) == 6 and Counter((r.doc_id, r.text) for r in kept) == {(5, b): 1, (100, a): 1, (None, a): 2, (7, None): 2}


def test_all_near_pairs_of_a_corpus_share_a_class(spark):
    rng = random.Random(8)
    docs = []
    for f in range(12):
        base = [f"f{f}w{rng.randrange(90)}" for _ in range(rng.randint(30, 200))]
        for k in range(12):
            w = base[:]
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            docs.append((1000 - len(docs), " ".join(w)))
    sets = {i: multiset(t) for i, t in docs}
    of = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    pairs = [(i, j) for i in sets for j in sets if i < j and near_dedup.multiset_jaccard(sets[i], sets[j]) >= 0.8]
    assert len(pairs) > 100 and all(of[i] == of[j] for i, j in pairs)
    root = {i: i for i in sets}
    for i, j in pairs:
        root = {k: root[i] if v == root[j] else v for k, v in root.items()}
    assert len(set(root.values())) == len(set(of.values()))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 2**63, 80).astype(np.uint64)
    a, b = rng.integers(0, 9, 80), rng.integers(0, 9, 80)
    w = np.concatenate([a, b])
    k = w > 0
    t = near_dedup.bag_min_hash(np.repeat([0, 1], 80)[k], np.concatenate([e, e])[k], w[k], 2, 8192)
    assert abs((t[0] == t[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_near_duplicates(spark):
    docs, _ = corpus()
    got = near_dedup.near_duplicates(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    of = {r.doc_id: r.class_id for r in got}
    assert {of[i] for i in (100, 101, 102, 103)} == {100} and of[108] == of[109] == 108
    assert of[106] == 106 and of[107] == 107 and of[None] is None
    assert sum(1 for r in got if not r.keep) == 5
    kept = near_dedup.keep_one(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "class_id", "words"] and kept.where("doc_id is null").count() == 1
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_a_hub_with_the_largest_id(spark):
    rng = random.Random(5)
    base = [f"h{i}" for i in range(400)]
    docs = [(1000, " ".join(base))]
    for i in range(120):  # each copy is some 0.86 like the hub, two copies some 0.74 like each other
        copy = base[:]
        for k in rng.sample(range(5, 395, 6), 6):
            copy[k] = f"c{i}x{k}"
        docs.append((i, " ".join(copy)))
    sets = {i: multiset(t) for i, t in docs}
    assert all(near_dedup.multiset_jaccard(sets[i], sets[1000]) >= 0.8 for i in range(120))
    assert sum(near_dedup.multiset_jaccard(sets[0], sets[i]) >= 0.8 for i in range(1, 120)) < 12
    keys = {i: set(near_dedup.bands(near_dedup.bag_min_hash(np.zeros(len(h), np.int64), h, n, 1, 160), 5)[0].tolist()) for i, (h, n) in sets.items()}
    assert all(keys[i] & keys[1000] for i in range(120))
    got = near_dedup.near_duplicates(frame(spark, docs)).collect()
    assert {r.class_id for r in got} == {0} and sum(r.keep for r in got) == 1


def test_tiles_compare_all_pairs_of_unlike_parts(spark):
    base = [prose(60).split() for _ in range(4)]
    texts = []
    for i in range(60):
        copy = base[i % 4][:]
        copy[R.randrange(60)] = f"t{i}"
        copy[R.randrange(60)] = f"u{i}"
        texts.append(" ".join(copy))
    left = spark.createDataFrame([(7, i, 0 if i % 4 == 0 and i < 40 else i) for i in range(60)], "bucket long, member long, part long")
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    sets = [multiset(t) for t in texts]
    similar = {(i, j) for i in range(60) for j in range(i) if near_dedup.multiset_jaccard(sets[i], sets[j]) >= 0.7}

    def classes(pairs):
        root = list(range(60))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [b if x == a else x for x in root]
        return {frozenset(k for k in range(60) if root[k] == x) for x in root}

    same = [(i, 0) for i in range(0, 40, 4)]
    got = near_dedup._across(left, docs, 0.7, 5, group=8).collect()
    assert all(abs(near_dedup.multiset_jaccard(sets[r.a], sets[r.b]) - r.similarity) < 1e-12 and r.similarity >= 0.7 for r in got)
    assert classes([(r.a, r.b) for r in got] + same) == classes(list(similar) + same)


def test_compact_windows_are_the_trees_nodes():
    rng = np.random.default_rng(1)
    shingles, ends, width = rng.integers(0, 60, 400).astype(np.uint64) * np.uint64(7919), np.array([100, 130, 130, 400]), 20
    value, left, c, right = substring_dedup.compact_windows(shingles, ends, 3, width)
    full = np.zeros(400, np.uint64)
    for k in range(400):  # a run of one shingle gives its value
        full[k] = substring_dedup.compact_windows(shingles[k : k + 1], np.array([1]), 3, 1)[0][0]
    want, todo = set(), [(0, 100), (100, 130), (130, 400)]
    while todo:
        a, b = todo.pop()
        if b - a >= width:
            m = a + int(np.argmin(full[a:b]))
            want.add((a, m, b - 1))
            todo += [(a, m), (m + 1, b)]
    assert set(zip(left.tolist(), c.tolist(), right.tolist())) == want


def test_windows_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 30, n).astype(np.uint64) for n in (0, 40, 3, 0, 0, 200, 5, 90, 0)]  # few values, so many ties
    ends = np.cumsum([len(t) for t in texts])
    together = set(zip(*(x.tolist() for x in substring_dedup.compact_windows(np.concatenate(texts), ends, 3, 6))))
    alone = set()
    for t, end in zip(texts, ends.tolist()):
        v, *bounds = substring_dedup.compact_windows(t, np.array([len(t)]), 3, 6)
        alone |= set(zip(v.tolist(), *((x + end - len(t)).tolist() for x in bounds)))
    assert together == alone and len(alone) > 20


def test_words_are_hashed_together_as_the_library_hashes_each(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé漢z\U0001f600") for _ in range(rng.randint(0, 45))) for _ in range(3000)] + ["a" * n for n in range(70)]
    hashed, one = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: hashed.append(x) or one(x))
    for given in (pa.array(words), pa.array(words)[7:], pa.array(["", "b"], pa.large_string()), pa.array([], pa.string())):
        assert word_hashes(given).tolist() == [one(w) for w in given.to_pylist()]
    assert all(len(x) >= 32 for x in hashed)


def test_shared_passages(spark):
    docs, passage = corpus()
    got = substring_dedup.shared_passages(frame(spark, docs)).collect()
    pair = next(r for r in got if (r.doc_id, r.other_doc_id) == (105, 104))
    assert pair.end_word - pair.start_word >= 50 and pair.similarity >= 0.8
    linked = {r.doc_id for r in got} | {r.other_doc_id for r in got}
    assert linked == {100, 101, 102, 103, 104, 105}
    assert substring_dedup.shared_passages(frame(spark, [])).count() == 0


def pairs_among_decoys(spark, n_words, part, decoys, change, pairs=20):
    """Of pairs of documents with one passage in common, how many are found where others hold only its first or last words."""
    rng = random.Random(n_words + change)
    fill = lambda: [f"z{rng.randrange(10**7)}" for _ in range(rng.randint(0, 60))]
    docs, want = {}, set()
    for p in range(pairs):
        run = [f"p{p}q{i}" for i in range(n_words)]
        other, k = run[:], rng.randrange(5, n_words - 5)
        if change:  # 1: a word is another, 2: a word is added
            other[k : k + 2 - change] = ["changed"]
        ids = rng.sample(range(10**9), 2 + 2 * decoys)
        want.add((max(ids[:2]), min(ids[:2])))
        docs |= {i: " ".join(fill() + w + fill()) for i, w in zip(ids, [run, other] + [run[:part], run[n_words - part :]] * decoys)}
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.shared_passages(frame(spark, docs.items()).repartition(5)).collect()}
    assert got <= want
    return len(got) / len(want)


def test_pairs_are_found_among_documents_with_parts_of_their_passage(spark):
    assert pairs_among_decoys(spark, 60, 40, 20, 0) == 1
    assert pairs_among_decoys(spark, 50, 47, 10, 0) == 1
    assert pairs_among_decoys(spark, 60, 40, 20, 1) >= 0.9
    assert pairs_among_decoys(spark, 60, 40, 20, 2) >= 0.9


def test_near_pairs_are_found_where_earlier_documents_share_what_surrounds_the_change(spark):
    rng = random.Random(4)
    fill = lambda n=30: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], set()
    for p in range(20):
        run = [f"p{p}q{i}" for i in range(50)]
        other = [*run[:25], "changed", *run[26:]]
        texts = [[*run[:22], *fill(6), *run[28:]] for _ in range(5)] + [run, other]  # the first five are like none of the others
        docs += [(7 * p + k, " ".join([*fill(), *t, *fill()])) for k, t in enumerate(texts)]
        want.add((7 * p + 6, 7 * p + 5))
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.shared_passages(frame(spark, docs).repartition(3)).collect()}
    assert got <= want and len(got) >= 18  # two hash functions' least shingles can both lie on the change


def test_near_pairs_are_found_wherever_the_change_lies_and_whoever_leads(spark):
    rng = random.Random(6)
    fill = lambda n=30: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], set()
    for p in range(60):
        run, k = [f"p{p}q{i}" for i in range(53)], rng.randrange(5, 48)
        other = [*run[:k], *[["changed"], [run[k], "added"], []][p % 3], *run[k + 1 :]]
        texts = [[*run[: max(k - 3, 0)], *fill(6), *run[k + 3 :]] for _ in range(5)] + [run, other]
        docs += [(7 * p + i, " ".join([*fill(), *t, *fill()])) for i, t in enumerate(texts)]
        want.add((7 * p + 6, 7 * p + 5))
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.shared_passages(frame(spark, docs).repartition(3)).collect()}
    assert got == want


def test_stretches_of_a_group_are_linked_as_brute_force_links_them():
    rng = np.random.default_rng(1)
    for _ in range(100):
        m = int(rng.integers(1, 14))
        r = np.zeros(m, substring_dedup._STRETCH)
        r["run"], r["key"], r["inner"], r["sides"] = np.sort(rng.integers(0, 2, m)), np.arange(m), 1, 1
        r["inner"][:, :6], r["sides"][:, :2] = rng.integers(0, 2, (m, 6)), rng.integers(1, 3, (m, 2))

        def classes(pairs):
            root = list(range(m))
            for i, j in pairs:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
            return {frozenset(k for k in range(m) if root[k] == x) for x in root}

        pairs = [(i, j) for i in range(m) for j in range(i) if r["run"][i] == r["run"][j]]
        copies = [(i, j) for i, j in pairs if (r["inner"][i] == r["inner"][j]).all() and (r["sides"][i] == r["sides"][j]).all()]
        alike = [(i, j) for i, j in pairs if substring_dedup._alike(r[i], r[j : j + 1])[0]]
        first, more = ([*zip(x.tolist(), y.tolist())] for x, y in substring_dedup._met(r))
        assert classes([*more, *copies, *(p for p in first if p in alike)]) == classes([*alike, *copies])


def test_small_groups_of_stretches_are_compared_together(monkeypatch):
    rng = np.random.default_rng(2)
    r = np.zeros(3000, substring_dedup._STRETCH)
    r["run"], r["key"] = np.arange(3000) // 3, np.arange(3000)
    r["inner"], r["sides"] = rng.integers(0, 2, (3000, 10)), rng.integers(1, 3, (3000, 14))
    calls, alike = [], substring_dedup._alike
    monkeypatch.setattr(substring_dedup, "_alike", lambda *args: calls.append(1) or alike(*args))
    want = [list(map(tuple, zip(*x))) for x in substring_dedup._met(r)]
    assert len(calls) < 10  # not some for each of the 1,000 groups
    monkeypatch.setattr(substring_dedup, "_SMALL", 0)  # each group by itself
    assert [list(map(tuple, zip(*x))) for x in substring_dedup._met(r)] == want and want[1]


def test_every_document_with_a_passage_has_a_row(spark):
    rows = spark.createDataFrame([(9, 4, 0, 50, 10, 61, 0.9)], "doc_id long, other_doc_id long, start_word int, end_word int, other_start int, other_end int, similarity double")
    assert sorted(map(tuple, substring_dedup.both_ways(rows).collect())) == [(4, 9, 10, 61, 0, 50, 0.9), (9, 4, 0, 50, 10, 61, 0.9)]


def test_common_runs_are_all_found(spark):
    rng = random.Random(9)
    passages = [[f"p{k}q{i}" for i in range(rng.randint(50, 80))] for k in range(10)]
    variant = passages[0][:]  # shares the middle, in a document that comes first, and is under the threshold
    for k in (6, 14, len(variant) - 12, len(variant) - 4):
        variant[k] = f"changed{k}"
    docs = [(0, " ".join([*prose(40).split(), *variant, *prose(40).split()]))]
    for i in range(1, 90):
        p = passages[i % 10]
        docs.append((i, " ".join([*prose(rng.randint(0, 90)).split(), *p, *prose(rng.randint(0, 90)).split()])))
    docs += [(i, prose(150)) for i in range(100, 130)]
    root = {i: i for i, _ in docs}
    found = substring_dedup.shared_passages(frame(spark, docs)).collect()
    for r in found:
        assert r.doc_id > r.other_doc_id and r.end_word - r.start_word >= 50 and r.similarity >= 0.8
        root = {k: root[r.doc_id] if v == root[r.other_doc_id] else v for k, v in root.items()}
    for p in range(10):
        assert len({root[i] for i in range(1, 90) if i % 10 == p}) == 1
    assert not any(100 <= x < 130 for r in found for x in (r.doc_id, r.other_doc_id))
    again = docs + [(3, docs[3][1]), (3, prose(80)), (None, docs[3][1])]
    assert substring_dedup.shared_passages(frame(spark, again)).count() == len(found)


def test_stupid_backoff(spark):
    docs, _ = corpus()
    got = Counter()
    for r in lm_scoring.stupid_backoff(frame(spark, docs), block_chars=4000).collect():
        got[(r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 6))] += 1
    words = [(i, (t or "").split()) for i, t in docs]
    counts = [Counter(tuple(w[k : k + n]) for _, w in words for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total, want = sum(counts[0].values()), Counter()
    for i, w in words:
        score, backed = 0.0, 0
        for k in range(len(w)):
            n = top = min(3, k + 1)
            while n > 1 and counts[n - 1][tuple(w[k + 1 - n : k + 1])] < 2:
                n -= 1
            g = tuple(w[k + 1 - n : k + 1])
            score += (top - n) * math.log(0.4) + math.log(counts[n - 1][g] / (counts[n - 2][g[:-1]] if n > 1 else total))
            backed += n < top
        want[(i, len(w), backed, round(score, 6))] += 1
    assert sum(got.values()) == len(docs) and {k[:3] for k in got} == {k[:3] for k in want}
    assert max(abs(a[3] - b[3]) for a, b in zip(sorted(got, key=str), sorted(want, key=str))) < 1e-4
    assert lm_scoring.stupid_backoff(frame(spark, [])).count() == 0


def test_packed_hashes_round_trip():
    for n, top in [(1, 2**64 - 1), (1000, 2**64 - 1), (5000, 2**20)]:
        v = np.unique(np.random.default_rng(n).integers(0, top, n, dtype=np.uint64))
        size, data = lm_scoring.pack_sorted(v)
        assert (lm_scoring.unpack_sorted(size, len(v), data) == v).all()


def test_statistics_and_learned_rules(spark):
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((i, " ".join(f"{w}###" for w in prose(80).split()) if bad else prose(80)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None), (1001, ""), (1002, "a b c " * 100), (1003, prose(60) + "\nsame line\n \nsame line"), (0, prose(70))]
    docs = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in rows], "doc_id long, text string, n_words int, _n int, _stats int")
    lab = spark.createDataFrame(labels + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(docs, lab, name="found").select("doc_id", "text", "found.*").collect()
    assert len(got) == len(rows)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines, r.n_symbols) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", r.text or "")))
        assert r.kept == (not (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.n_symbols == 0)
    kept = quality_rules.keep_good(docs, lab)
    assert kept.columns == ["doc_id", "text", "n_words", "_n", "_stats"]
    assert quality_rules.keep_good(docs, lab.limit(0)).count() > kept.count()
    assert quality_rules.judged(docs.limit(0), lab, name="found").count() == 0
