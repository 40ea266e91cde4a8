"""Substring removal, Jaccard join, decontamination and packing against brute force, and on odd rows."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ODD, extras_are_kept, sentence

from colweave.llm import common, decontaminate, jaccard_join, packing, substring_dedup
from colweave.llm.queries import tokenizer_path


def brute_kept(texts, length):
    every = [common.words(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in every for i in range(len(w) - length + 1))
    out = []
    for w in every:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("length,anchor", [(35, 16), (8, 3), (5, 5)])
def test_substring_removal_equals_brute_force(small, small_docs, length, anchor):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(small_docs, length=length, anchor=anchor).collect()}
    want = brute_kept([t for _, t in small], length)
    assert sum(w[1] for w in want) > 0
    assert got == {i: w for (i, _), w in zip(small, want)}


def test_substring_spans_are_the_removed_words(small_docs):
    for r in substring_dedup.remove_repeats(small_docs, length=8, anchor=3).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substring_removal_on_odd_rows(odd, none):
    out = substring_dedup.remove_repeats(odd)
    assert "a.b" in out.columns and out.columns.count("kept") == 1
    rows = out.collect()
    assert extras_are_kept(rows, "kept", "n_words")
    want = brute_kept([t for _, t in ODD], 35)
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in rows) == sorted((i or -1, n, m) for (i, _), (n, m, _) in zip(ODD, want))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_repeated_rows_are_repeats(spark):
    text = sentence(random.Random(1), 50)
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")).collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in rows] == [(50, 50, "")] * 2


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = common.words(t, lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("settings", [jaccard_join.Settings(), jaccard_join.Settings(family_rows=3, chunk_rows=2, star_rounds=1)])
def test_jaccard_join_equals_brute_force(small, small_docs, settings):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(small_docs, settings=settings).collect()}
    want = brute_components(small)
    assert len({c for _, c in want.values()}) < len(want)
    assert got == want


def test_jaccard_join_on_a_chain_and_at_the_threshold(spark):
    words = [f"t{i}" for i in range(104)]
    rows = [(i, " ".join(words[i : i + 94])) for i in range(0, 11)]  # each step swaps one n-gram of 90
    rows += [(50, "a b c d e f g h i"), (51, "a b c d e f g h z")]  # 4 of 6 n-grams: below 0.8
    rows += [(60, " ".join(f"u{i}" for i in range(8))), (61, " ".join(f"u{i}" for i in range(9)))]  # 4 of 5: at 0.8
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}
    assert got[51] == 51 and got[61] == 60


def test_jaccard_join_on_odd_rows(odd, none):
    rows = jaccard_join.join(odd).collect()
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None)
    assert [x for x in got if x[0] < 9] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (6, 1, 5), (6, 1, 5), (8, 1, 8)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None] and len(rows) == len(ODD)
    assert jaccard_join.join(none).count() == 0


def test_rtree_finds_all_pairs_over_the_bound():
    rng = np.random.default_rng(4)
    base = rng.poisson(3, (12, 16))
    points = np.concatenate([base + rng.integers(0, 2, base.shape) for _ in range(20)])
    sizes = points.sum(axis=1)
    tree = jaccard_join.Tree(points, sizes)
    for q in range(0, len(points), 7):
        bound = np.minimum(points, points[q]).sum(axis=1)
        fits = (sizes * 80 <= sizes[q] * 100) & (sizes * 100 >= sizes[q] * 80)
        assert sorted(tree.search(q, 80)) == np.flatnonzero(fits & (bound * 180 >= 80 * (sizes + sizes[q]))).tolist()


def brute_bm25(items, words, s):
    entries = [(i, e) for i, t in items for e in decontaminate.entries_of(t, s.entry_words)]
    df = Counter(w for _, e in entries for w in set(e))
    mean = sum(len(e) for _, e in entries) / len(entries)
    out = {}
    for k, (_, e) in enumerate(entries):
        tf = Counter(e)
        weight = {
            t: np.log(1 + (len(entries) - df[t] + 0.5) / (df[t] + 0.5)) * n * (s.k1 + 1) / (n + s.k1 * (1 - s.b + s.b * len(e) / mean)) for t, n in tf.items()
        }
        score = sum(w for t, w in weight.items() if t in set(words)) / sum(weight.values())
        if score >= s.threshold:
            out[k] = score
    return out


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.randint(3, 30), 60)) for i in range(150)]
    for threshold in (0.3, 0.7):
        s = decontaminate.Settings(threshold=threshold, postings_block=4)
        df = Counter(w for _, t in items for w in set(t.split()))
        index = decontaminate.Index(items, df, len(items), sum(len(t.split()) for _, t in items) / len(items), s)
        hits = 0
        for _ in range(60):
            words = sentence(rng, rng.randint(1, 40), 60).split()
            want = brute_bm25(items, words, s)
            got = index.search(sorted({index.terms[w] for w in words if w in index.terms}))
            assert got == pytest.approx(want)
            if want:
                assert 0 in index.passages(np.array([index.terms.get(w, -1) for w in words]), 64)
            hits += len(want)
        assert hits


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(2)
    items = [(i, f"{sentence(rng, 25, 5000)}\n{sentence(rng, 6, 5000)}") for i in range(40)] + [(77, None), (78, ""), (79, "?!"), (80, sentence(rng, 700, 5000)), (81, "x")]
    held = dict(items)
    docs, want = [], set()
    for d in range(60):
        parts = [sentence(rng, rng.randint(5, 400), 5000)]
        if d % 3 == 0:
            leaked = rng.choice([*range(40), 80])
            parts.insert(rng.randint(0, 1), held[leaked].upper().replace(" ", "  ") + ".")
            want.add((d, leaked))
        docs.append((d, "\n".join(parts)))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for s in (decontaminate.Settings(), decontaminate.Settings(index_bytes=2000)):
        indexes = decontaminate.build_indexes(benchmark, settings=s)
        rows = decontaminate.find_leaks(frame, indexes).selectExpr("doc_id", "inline(leaks)").collect()
        assert {(r.doc_id, r.item_id) for r in rows if r.item_id != 81} == want


def brute_leaks(items, text):
    """The README's definition over the whole document."""
    words = decontaminate.split_words(text)

    def share(part):
        width = min(5, len(part))
        own = {tuple(part[k : k + width]) for k in range(len(part) - width + 1)}
        held = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
        return len(own & held) / len(own)

    out = set()
    for i, t in items:
        question, answer = decontaminate.question_and_answer(t)
        whole = decontaminate.split_words(t)
        if whole and (share(whole) >= 0.8 or (share(question) >= 0.5 and (not answer or share(answer) >= 0.5))):
            out.add(i)
    return out


def test_partial_and_separated_leaks_equal_brute_force(spark):
    rng = random.Random(31)
    items = [(i, sentence(rng, rng.randint(4, 40), 5000)) for i in range(40)]
    items += [(100 + i, f"{sentence(rng, rng.randint(6, 40), 5000)}\n{sentence(rng, rng.randint(1, 9), 5000)}") for i in range(40)] + [(200, sentence(rng, 700, 5000))]
    docs = []
    for i, t in items:
        question, answer = decontaminate.question_and_answer(t)
        far, w = sentence(rng, 900, 5000), decontaminate.split_words(t)
        docs += [f"{' '.join(question)} {far} {' '.join(answer)}", f"{' '.join(answer)} {far} {' '.join(question)}"]
        docs += [f"{far} {' '.join(w[: int(len(w) * share)])} x" for share in (0.4, 0.5, 0.62, 0.75, 0.9)]
        half = len(question) * 5 // 8 + 2
        docs += [f"{' '.join(question[:half])} {far} {' '.join(answer)}", f"{' '.join(question[: half // 2 + 3])} {far} {' '.join(question[half // 2 :])}", far]
    docs += [" ".join(items[0][1].split()[:k]) for k in range(6)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    want = {(d, i) for d, t in enumerate(docs) for i in brute_leaks(items, t)}
    for s in (decontaminate.Settings(), decontaminate.Settings(index_bytes=4000)):
        rows = decontaminate.find_leaks(frame, decontaminate.build_indexes(benchmark, settings=s)).selectExpr("doc_id", "inline(leaks)").collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
        assert any(r.score < s.threshold for r in rows) and all(0 < r.score < 1 + 1e-9 for r in rows)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_no_accepted_overlap_weighs_less_than_the_bound(width):
    rng = random.Random(width)
    for _ in range(60):
        weights = np.array([rng.choice([0.0, 0.5, rng.random() * 3]) for _ in range(rng.randint(width, 11))])
        runs = len(weights) - width + 1
        for need in range(runs + 1):
            covers = [{p for r in chosen for p in range(r, r + width)} for chosen in itertools.combinations(range(runs), need)]
            assert decontaminate.lightest_runs(weights, width, need) == pytest.approx(min(weights[list(c)].sum() for c in covers))


def test_an_item_without_an_id_keeps_its_null(spark):
    items = [(None, "alpha beta gamma delta epsilon zeta"), (-1, "one two three four five six seven")]
    docs = spark.createDataFrame([(1, items[0][1]), (2, items[1][1])], "doc_id bigint, text string")
    for s in (decontaminate.Settings(), decontaminate.Settings(index_bytes=20)):
        indexes = decontaminate.build_indexes(spark.createDataFrame(items, "item_id bigint, text string"), settings=s)
        rows = decontaminate.find_leaks(docs, indexes).selectExpr("doc_id", "inline(leaks)").collect()
        assert {(r.doc_id, r.item_id) for r in rows} == {(1, None), (2, -1)}


def test_decontamination_on_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "no id here at all")], "item_id bigint, text string")
    indexes = decontaminate.build_indexes(benchmark)
    out = decontaminate.find_leaks(odd, indexes)
    assert dict(out.dtypes)["leaks"].startswith("array") and extras_are_kept(out.collect(), "leaks")
    slices = decontaminate.build_indexes(benchmark, settings=decontaminate.Settings(index_bytes=8))
    assert sorted(map(str, decontaminate.find_leaks(odd, slices).collect())) == sorted(map(str, out.collect())) and slices.slices > 1
    assert sorted(r.doc_id or -1 for r in out.where("size(leaks) > 0").collect()) == [-1, 5, 6, 6]
    assert decontaminate.find_leaks(none, indexes).count() == 0
    assert decontaminate.find_leaks(odd, decontaminate.build_indexes(benchmark.limit(0))).where("size(leaks) > 0").count() == 0


def check_packing(rows, ids, window):
    """Every id in one piece, no gap in any document or sequence; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and zlib.crc32(own.astype("<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces, sizes in ((by_doc, {d: len(x) for d, x in ids.items()}), (by_sequence, None)):
        for key, parts in pieces.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            if sizes:
                assert at == sizes[key]
            else:
                assert at <= window
                padding += 0 if at & (at - 1) == 0 else window - at
    assert set(by_doc) == set(ids)
    return padding


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_is_an_exact_round_trip(small, small_docs, window):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array(slow.encode(t, add_special_tokens=False).ids + [1], np.uint32) for i, t in small}
    rows = packing.pack(small_docs, tokenizer_path(), settings=packing.Settings(window=window)).collect()
    assert check_packing(rows, ids, window) < 2 * window


def test_packing_on_odd_rows(odd, none):
    rows = packing.pack(odd, tokenizer_path()).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total[1] == total[2] == 1 and total[6] == 2 * total[5]
    assert [r.doc_tokens for r in rows if r.doc_id == 10] == [6]  # the special token's string is one id
    assert packing.pack(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {1500: 1000}, {2047: 7, 1: 3}, {1000: 100_001, 30: 5}, {i: i % 31 for i in range(1, 2048)}])
def test_plans_place_every_rest_once_with_little_padding(histogram):
    s = packing.Settings()
    plan = packing.make_plan(histogram, s)
    placed, filled = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for rest, low, high, start, piece, sequence, offset in plan.rows:
        placed[rest][low] += 0
        placed[rest, "tokens"][0] += (high - low) * piece
        if high - low < 50:
            for k in range(high - low):
                filled[sequence + k] += piece
    for rest, n in histogram.items():
        assert placed[rest, "tokens"][0] == rest * n
    assert plan.padding < s.window and all(v <= s.window for v in filled.values())


def test_least_squares_fills_most_sequences():
    plan = packing.make_plan({i: 40 + i % 7 for i in range(1, 2048)}, packing.Settings())
    assert plan.solved > 0.5 * plan.sequences


