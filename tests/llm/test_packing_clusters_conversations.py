"""Genetic packing, centroid clustering and conversation repair, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from conftest import ODD, SF_DIR

import check
from colweave.llm import centroids, conversations, packing_genes, queries
from colweave.llm.queries import tokenizer_path
from colweave.llm.tokens import encoder

# ---- genetic packing ------------------------------------------------------------------------------------------------


def check_pieces(rows, texts, window):
    """Pieces hold every id once, by the rules of cutting, and sequences have no gaps and no more than the window."""
    encode = encoder(tokenizer_path())
    want = Counter()
    for i, t in texts:
        ids = np.append(encode(t or ""), np.uint32(0)).astype("<u4")
        short = len(ids) % window
        cuts = sorted({0, *range(short, len(ids), window), len(ids)})
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


@pytest.mark.parametrize("window", [16, 64, 2048])
def test_genetic_packing_is_an_exact_round_trip(small, small_docs, window):
    settings = packing_genes.Settings(window=window, islands=2, epochs=2, children=6, bucket_docs=1)
    rows = packing_genes.pack(small_docs, tokenizer_path(), settings=settings).collect()
    used = check_pieces(rows, small, window)
    sizes = [r.length for r in rows]
    assert -(-sum(sizes) // window) <= used <= packing_genes.bins_of(packing_genes.best_fit({}, sorted(Counter(sizes).items(), reverse=True), window))


def test_genetic_packing_on_odd_rows(spark, odd, none):
    out = packing_genes.pack(odd, tokenizer_path())
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "bigint", "bigint"]
    check_pieces(out.collect(), ODD, 2048)
    assert packing_genes.pack(none, tokenizer_path()).count() == 0


def test_a_third_of_all_rows_alike_are_placed_apart(spark):
    rows = [(None, "same text in every row")] * 400 + [(i, f"text {i} " * (i % 40)) for i in range(800)]
    settings = packing_genes.Settings(window=256, children=4, epochs=1, bucket_docs=10)
    out = packing_genes.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), tokenizer_path(), settings=settings)
    check_pieces(out.collect(), rows, 256)


def lengths_of(bins):
    out = Counter()
    for held, n in bins.items():
        for length in held:
            out[length] += n
    return out


HISTOGRAMS = {
    "few": {700: 10, 650: 11, 340: 9, 1200: 4},
    "one": {5: 1},
    "halves": {1024: 7, 1025: 3, 1: 4},
    "uniform": dict(Counter(random.Random(1).randrange(200, 700) for _ in range(300))),
    "many": {k: 10**9 + k for k in range(300, 900, 7)},
    "hot": {21: 10**6} | {k: 3 for k in range(1000, 2048)},
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_solutions_hold_every_document_once(name):
    counts, s = HISTOGRAMS[name], packing_genes.Settings(children=8)
    least = packing_genes.least_bins(counts, s.window)
    first = packing_genes.best_fit({}, sorted(counts.items(), reverse=True), s.window)
    population, rng = [], random.Random(3)
    for _ in range(3):
        population = packing_genes.evolve(population, counts, least, rng, s)
        for bins in population:
            assert lengths_of(bins) == Counter(counts) and all(sum(held) <= s.window for held in bins) and all(n > 0 for n in bins.values())
            assert least <= packing_genes.bins_of(bins)
    assert packing_genes.bins_of(population[0]) <= packing_genes.bins_of(first)


def triplets(n, seed=1):
    """Documents that fill n windows exactly, three by three."""
    rng, out = random.Random(seed), Counter()
    for _ in range(n):
        a = rng.randrange(520, 800)
        b = rng.randrange(520, 2048 - a - 500)
        out.update((a, b, 2048 - a - b))
    return dict(out)


def test_islands_do_better_than_best_fit(spark):
    counts, s = triplets(100), packing_genes.Settings()
    first = packing_genes.bins_of(packing_genes.best_fit({}, sorted(counts.items(), reverse=True), s.window))
    best = packing_genes.solve(spark, counts, s)
    assert lengths_of(best) == Counter(counts)
    assert 100 == packing_genes.least_bins(counts, s.window) <= packing_genes.bins_of(best) <= first - 4


def test_crossover_keeps_whole_bins_of_the_father():
    rng, counts = random.Random(5), triplets(40)
    mother = packing_genes.best_fit({}, sorted(counts.items(), reverse=True), 2048)
    father = packing_genes.best_fit({}, sorted(counts.items()), 2048)
    kept = 0
    for _ in range(20):
        child = packing_genes.crossover(rng, mother, father, 2048)
        assert lengths_of(child) == Counter(counts)
        kept += sum(min(n, father[held]) for held, n in child.items() if held in father and held not in mother)
    assert kept > 0


# ---- centroid clustering --------------------------------------------------------------------------------------------


def brute_clusters(rows, clusters=8, rounds=10, scale=1024, seed="3"):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in v]))
    order = sorted(((i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept))
    points = [v for _, _, v in order[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, p)), k) for k, p in enumerate(points)))
        return out

    for _ in range(rounds):
        found = assign()
        for k in range(len(points)):
            own = [v for (_, v), (_, j) in zip(kept, found) if j == k]
            if own:
                points[k] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    inertia = Counter()
    for d, k in found:
        inertia[k] += d
    short = lambda x: x if x < 1 << 63 else None
    return Counter(
        (i, k, short(d), short(inertia[k]), short(sum(inertia.values())), tuple(map(str, points[k]))) for (i, _), (d, k) in zip(kept, found)
    )


def clusters_of(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


def some_vectors(n, seed=2, groups=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    return [(i, (centres[i % groups] + 0.3 * rng.normal(size=64)).tolist()) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = some_vectors(150) + some_vectors(20)  # rows repeat
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    assert clusters_of(centroids.cluster(frame)) == brute_clusters(rows)


def test_clusters_of_odd_vectors(spark):
    odd = [
        (1, None),
        (2, []),
        (3, [0.5] * 63),
        (4, [0.5] * 65),
        (5, [0.5] * 63 + [None]),
        (6, [0.5] * 63 + [float("nan")]),
        (7, [0.5] * 63 + [float("inf")]),
        (8, [0.0] * 64),
        (9, [0.0] * 64),
        (9, [0.0] * 64),
        (9, [-1e-300] * 64),
        (None, [0.25] * 64),
        (10, [3.0e38] + [0.0] * 63),
        (11, [-1.7e308] * 64),
        (12, [5e5] * 64),
        (13, [1e9, -1e9] * 32),
    ]
    rows = odd + some_vectors(30, seed=4)
    extra = "cluster string, Distance string, x string, vector string, c0 string, i0 string"
    frame = spark.createDataFrame([(i, v, "a", "b", "c", "d", "e", "f") for i, v in rows], f"vec_id bigint, embedding array<double>, {extra}")
    got = centroids.cluster(frame.repartition(3))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert clusters_of(got) == brute_clusters(rows)
    few = frame.where("vec_id in (1, 6, 8, 9)")
    assert clusters_of(centroids.cluster(few)) == brute_clusters([r for r in rows if r[0] in (1, 6, 8, 9)])
    assert centroids.cluster(frame.limit(0)).collect() == []
    assert centroids.cluster(frame.where("vec_id < 8 and vec_id > 0").where("size(embedding) <> 64 or embedding is null")).collect() == []


def test_the_transform_is_exact_and_coarse_to_fine():
    x = np.random.default_rng(1).integers(-(2**20), 2**20, size=(30, 64))
    y = centroids.transform(x)
    assert (((y[:, None] - y[None]) ** 2).sum(axis=2) == 64 * ((x[:, None] - x[None]) ** 2).sum(axis=2)).all()
    assert (y[:, 0] == x.sum(axis=1)).all() and (y[:, 1] == x[:, :32].sum(axis=1) - x[:, 32:].sum(axis=1)).all()
    wide = centroids.transform(x.astype(object) * 10**30)
    assert (wide == y.astype(object) * 10**30).all()


@pytest.mark.parametrize("spread", [0, 1, 1000])
def test_the_search_is_exact_and_skips_far_centroids(spread):
    rng = np.random.default_rng(spread)
    ramp = np.linspace(-1, 1, 64)
    points = np.array([np.round(500 * k * ramp) for k in range(8)]).astype(np.int64)
    x = points[rng.integers(0, 8, 500)] + (rng.integers(-spread, spread + 1, size=(500, 64)) if spread else 0)
    x[::7] = (points[2] + points[3]) // 2  # ties and near ties
    choice, sums, taken = centroids.nearest(centroids.transform(x), centroids.transform(points), (4, 16, 32, 64))
    every = ((x[:, None] - points[None]) ** 2).sum(axis=2)
    assert (choice == every.argmin(axis=1)).all() and (sums == 64 * every.min(axis=1)).all()
    if spread < 1000:
        assert taken < 0.5 * 500 * 8 * 64


# ---- conversation repair --------------------------------------------------------------------------------------------


def brute_repair(rows):
    """rows: (turn, role, text) of one conversation. A different way: costs to go, from the last row back."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen, illegal = [], set(), 0
    for i, (_, role, text) in enumerate(rows):
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(maxsize=None)
    def best(i, state, inserted=0):
        """(cost, edits, made) from row i on."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for name in ("user", "assistant"):
            if inserted < 4 and name[0] in after[state]:
                c, e, m = best(i, name[0], inserted + 1)
                found.append((c + 3, "I" + e, ((name, ""),) + m))
        if i < len(rows):
            _, role, text = rows[i]
            c, e, m = best(i + 1, state)
            found.append((c + 4, "D" + e, m))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] and role[:1] in after[state]:
                    c, e, m = best(i + 1, role[:1])
                    found.append((c + more, "K" + e, ((role, text),) + m))
                for name in ("user", "assistant"):
                    if name[0] in after[state]:
                        c, e, m = best(i + 1, name[0])
                        found.append((c + 3 + more, "R" + e, ((name, text),) + m))
        return min(found, default=(1 << 40, "", ()))

    cost, audit, made = best(0, "")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    kinds = Counter(faults)
    return (gaps if gaps < 1 << 63 else None, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, digest), list(made)


def some_conversations(seed, many=300, most=7):
    rng = random.Random(seed)
    rows = []
    for conv in range(many):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ursine", "", None])
            text = rng.choice(["one.", "two!", "three", "", " \n", "four?\x0b ", "été 中。", None, f"own {rng.randrange(9)}."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 2 * turn, 1]), role, text))
    return rows


def by_conversation(rows):
    out: dict = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TYPES = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("spill_rows", [1, 3, 1 << 20])
def test_repairs_equal_brute_force(spark, spill_rows):
    rows = some_conversations(spill_rows) + [(None, 1, "user", "no id."), (None, 2, "assistant", "still none.")]
    frame = spark.createDataFrame(rows, TYPES).repartition(6)
    out = conversations.repair(frame, settings=conversations.Settings(spill_rows=spill_rows))
    got = {r.conv_id: tuple(r[x] for x in COUNTS) for r in out.collect()}
    assert got == {conv: brute_repair(own)[0] for conv, own in by_conversation(rows).items()}


def test_repaired_rows_are_those_of_the_audit(spark):
    rows = some_conversations(8) + [(None, None, "user", "no id."), (10**17 + 1, 1, "assistant", "x")]
    frame = spark.createDataFrame(rows, TYPES).repartition(5)
    repairs = conversations.repair(frame)
    made: dict = {}
    for r in sorted(conversations.repaired_turns(frame, repairs).collect(), key=lambda r: r.position):
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {conv: brute_repair(own)[1] for conv, own in by_conversation(rows).items()}
    assert made == {conv: turns for conv, turns in want.items() if turns}
    for r in repairs.collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made.get(r.conv_id, [])).encode()).hexdigest()


def test_a_giant_conversation_is_carried_over_batches_and_spilled(spark):
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["a.", f"b {t}.", f"c {t}", ""])) for t in range(6000)]
    rows += [(8, t, ("user", "assistant")[t % 2], f"fine {t}.") for t in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        frame = spark.createDataFrame(rows, TYPES).repartition(9)
        out = {r.conv_id: r for r in conversations.repair(frame, settings=conversations.Settings(spill_rows=1024)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tuple(out[8][x] for x in COUNTS) == brute_repair(by_conversation(rows)[8])[0] and out[8].cost == 0
    whole = conversations.repair(frame).where("conv_id = 7").first()
    assert tuple(out[7]) == tuple(whole) and len(whole.audit.replace("I", "")) == 6000


def test_repair_on_odd_rows(spark):
    rows = [
        (1, 2**62, "user", "a."),
        (1, -(2**62), "user", "b."),
        (2, 9223372036854775807, "user", "a."),
        (2, -9223372036854775808, "assistant", "b."),
        (3, None, None, None),
        (4, 1, "user", "x" * 1_000_000 + "."),
        (4, 1, "user", "x" * 1_000_000 + "."),
        (5, 0, "user", "same."),
        (5, 0, "assistant", "same."),
        (5, 1, "user", "same."),
        (5, 1, "user", "same."),
    ]
    clashing = "key string, digest string, fault string, Repeats string, fate string, copy string, audit string, seen_conv string"
    frame = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], f"{TYPES}, {clashing}")
    got = {r.conv_id: tuple(r[x] for x in COUNTS) for r in conversations.repair(frame).collect()}
    assert got == {conv: brute_repair(own)[0] for conv, own in by_conversation(rows).items()}
    assert got[2][0] is None and got[3][0] == 0
    assert conversations.repair(frame.limit(0)).count() == 0
    gone = conversations.repair(frame.where("conv_id = 4"), frame).where("conv_id = 5").first()
    assert tuple(gone) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_planted_damage(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in ((0, "system", "be. good!"), (1, "user", "ask?"), (None, None, None))]
    want = Counter()
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fate = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fate == 1 else x.translate({ord(p): None for p in ".!?"}) if fate == 2 else x
        want[c, t, "user" if fate == 4 else r, x] += 0 if fate == 0 else 2 if fate == 3 else 1
    got = Counter(map(tuple, conversations.damaged(spark.createDataFrame(rows, TYPES)).collect()))
    assert got == +want


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, SF_DIR)
    result = con.execute(queries.oracle_sql()[name])
    want = check.rows_of([d[0] for d in result.description], result.fetchall())
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
