"""Extraction, toxicity, language models, language ID, token counts, neighbours and the pipeline."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import EXTRA, ODD, SF_DIR, extras_are_kept, sentence

from colweave.llm import ann, common, html_extract, labelled_pages, language_id, ppm, queries, token_counts, toxicity
from colweave.llm.queries import END_OF_TEXT, tokenizer_path

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no";</script><style>p{}</style></head><body><nav><ul><li><a href="/x">x</a>'
    '<li><a href="/y">y</a></ul></nav><!-- <p>ad</p> --><div class="ad">Buy this now.</div><article><h1>A  title &amp; more</h1><p><b>First &lt;one&gt; line of'
    "\n text that goes on for a while.<br><p>Second caf&eacute; paragraph with&nbsp;some words.</p><p></p></article><footer>&copy; 2024 someone</footer>"
)
TEXT = "A title & more\n\nFirst <one> line of text that goes on for a while.\n\nSecond café paragraph with some words."


@pytest.fixture(scope="module")
def content():
    return html_extract.train()


def test_main_text_of_a_page_with_open_tags_and_scripts(content):
    assert html_extract.main_text(PAGE, content) == TEXT


def test_messages_give_exact_marginals(content):
    """Against the sum over all labellings of a small tree."""
    page = html_extract.parse('<body><div class="ad"><p>some words here</p></div><article><p>More words, and more words here.</p></article></body>')
    size, seen = len(page.tags), html_extract.features(page)
    total, yes = 0.0, [0.0] * size
    for labels in itertools.product((0, 1), repeat=size):
        p = content.prior if labels[0] else 1 - content.prior
        for i in range(size):
            if labels[i]:
                p *= math.exp(sum(content.evidence.get(f, 0.0) for f in seen[i]))
            if i:
                move = content.moves[html_extract._kind(page.tags[i])][labels[page.parents[i]]]
                p *= move if labels[i] else 1 - move
        total += p
        for i in range(size):
            yes[i] += p * labels[i]
    assert html_extract.marginals(page, content) == pytest.approx([y / total for y in yes], rel=1e-6)


def test_labelled_pages_of_another_filling(content):
    right = every = 0
    for html in labelled_pages.pages(4, seed=50):
        page = html_extract.parse(html)
        labels = []
        for i, raw in enumerate(page.attributes):
            own = [m[2] or m[3] for m in html_extract._ATTRIBUTE.finditer(raw) if m[1] == "data-y"]
            labels.append(int(own[0]) if own else labels[page.parents[i]] if i else 0)
        belief = html_extract.marginals(page, content)
        right += sum((belief[node] > 0.5) == bool(labels[node]) for node, _ in page.blocks)
        every += len(page.blocks)
    assert right / every > 0.97


def blocks_judged_right(content, pages):
    right = every = 0
    for html in pages:
        page = html_extract.parse(html)
        labels = []
        for i, raw in enumerate(page.attributes):
            own = [m[2] or m[3] or m[4] for m in html_extract._ATTRIBUTE.finditer(raw) if m[1] == "data-y"]
            labels.append(int(own[0]) if own else labels[page.parents[i]] if i else 0)
        belief = html_extract.marginals(page, content)
        right += sum((belief[node] > 0.5) == bool(labels[node]) for node, _ in page.blocks)
        every += len(page.blocks)
    return right / every


def test_layouts_left_out_of_training(monkeypatch):
    """Every written layout, by a model that has not seen it; the mean over layouts, and the worst."""
    layouts, shares = labelled_pages.LAYOUTS, []
    for k in range(len(layouts)):
        monkeypatch.setattr(labelled_pages, "LAYOUTS", layouts[:k] + layouts[k + 1 :])
        shares.append(blocks_judged_right(html_extract.train(), labelled_pages.filled(layouts[k : k + 1], 12, 99)))
    print([round(x, 3) for x in shares])
    assert sum(shares) / len(shares) >= 0.95 and min(shares) >= 0.8


def test_composed_pages_of_other_seeds(content):
    rng = random.Random(501)
    assert blocks_judged_right(content, labelled_pages.filled(tuple(labelled_pages.composed(rng) for _ in range(200)), 1, 77)) >= 0.97


@pytest.mark.parametrize("html", ["", "<", "<<<>>>", "a < b > c", "<div " * 50, "<p>" * 20_000, "<p><td></b></html><foot", '<a href="x', "&#0;&#x110000;&bogus;&am", "<!--"])
def test_broken_pages_do_not_crash(content, html):
    assert isinstance(html_extract.main_text(html, content), str)


def test_extraction_keeps_rows_and_columns(spark, content):
    rows = [(1, "u", None, "x"), (2, "v", "", "y"), (3, None, PAGE, "z"), (3, None, PAGE, "z"), (None, "w", "<p>" + "word " * 100_000, "")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, Text string")
    out = html_extract.extract(frame, content)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = out.collect()
    assert [r.text for r in got if r.page_id == 3] == [TEXT, TEXT] and [r.n_chars for r in got if r.page_id in (1, 2)] == [0, 0]
    assert all(len(r.text) == r.n_chars for r in got)
    assert html_extract.extract(frame.limit(0), content).count() == 0


def toxic_docs(spark, n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randint(5, 60)).split()
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "foul"]) + rng.choice(["", "!", "."])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0), 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_toxicity_of_held_out_documents(spark):
    docs, labels = toxic_docs(spark)
    index = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    assert {"vile", "foul"} <= set(index.terms)
    scores = {r.doc_id: (r.toxicity, r.examples) for r in toxicity.score(docs, index).collect()}
    held = [i for i in scores if i % 4 == 0]
    assert all((scores[i][0] >= 0.5) == (i % 5 == 0) for i in held) and all(0 <= s <= 1 for s, _ in scores.values())
    assert all(e.doc_id % 4 for _, near in scores.values() for e in near)


def test_nearest_examples_are_exact():
    rng = random.Random(9)
    terms = {f"w{i}": i for i in range(30)}
    examples = [(i, rng.randint(0, 1), {rng.randrange(30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}) for i in range(300)]
    index = toxicity.Index(terms, [1 + rng.random() for _ in range(30)], examples, toxicity.Settings(block=4))
    for _ in range(50):
        v = index.vector({rng.randrange(30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))})
        want = sorted(((-round(sum(v.get(t, 0) * w for t, w in u.items()), 12), e) for e, u in enumerate(index.vectors)))
        want = [(-c, e) for c, e in want if c < 0][:7]
        got = index.nearest(v, 7)
        assert [c for c, _ in got] == pytest.approx([c for c, _ in want])
        cut = want[-1][0] if want else 0
        assert {e for c, e in got if c > cut + 1e-9} == {e for c, e in want if c > cut + 1e-9}


@pytest.mark.parametrize("changed", [{}, {"block": 3, "frequent": 0.2}, {"frequent": 0.0}, {"table_bytes": 0}])
def test_all_words_are_searched_through_training(spark, changed):
    """Nearest examples, votes and evidence against brute force over all words of all examples."""
    docs, labels = toxic_docs(spark, 160)
    s = toxicity.Settings(near=5, **changed)
    index = toxicity.train(docs, labels.where("doc_id % 4 <> 0"), settings=s)
    texts = {r.doc_id: Counter(toxicity.WORD.findall(r.text.lower())) for r in docs.collect()}
    toxic = {i: i % 5 == 0 for i in texts if i % 4}
    words = set().union(*(texts[i] for i in toxic))
    assert set(index.terms) == words
    df = Counter(w for t in texts.values() for w in t)

    def weight(w):
        n, held, of = len(toxic), sum(w in texts[i] for i in toxic), sum(toxic.values())
        a = sum(w in texts[i] and toxic[i] for i in toxic)
        cells = [(a, of, held), (of - a, of, n - held), (held - a, n - of, held), (n - of - held + a, n - of, n - held)]
        g = 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in cells if o) if a * (n - of) > (held - a) * of else 0.0
        clear = max(g, 0.0) ** 2
        return (math.log((1 + len(texts)) / (1 + df[w])) + 1) * (0.1 + 0.9 * clear / (clear + s.clear**4))

    weights = {w: weight(w) for w in words}

    def unit(t):
        v = {w: (1 + math.log(n)) * weights[w] for w, n in t.items() if w in words}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: unit(texts[i]) for i in toxic}
    for r in toxicity.score(docs, index, evidence=5).collect():
        v = unit(texts[r.doc_id])
        want = sorted((-sum(x * u.get(w, 0.0) for w, x in v.items()), i) for i, u in vectors.items())[:5]
        assert [e.cosine for e in r.examples] == pytest.approx([-c for c, _ in want if c < 0], abs=1e-9)
        near = {e.doc_id for e in r.examples}
        assert {i for c, i in want if c < want[-1][0] - 1e-9} <= near
        vote = sum(toxic[i] / (0.05 + 1 - min(1, -c)) for c, i in want) / sum(1 / (0.05 + 1 - min(1, -c)) for c, i in want)
        if near == {i for _, i in want}:
            assert r.toxicity == pytest.approx(float(np.interp(vote, *index.knots)), abs=1e-6)


def test_rare_toxic_words_are_caught(spark):
    """Sixty insults, each in four labelled documents."""
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(3000):
        words = sentence(rng, rng.randint(20, 60), 2000).split()
        if i % 10 == 0:
            words.insert(rng.randrange(len(words)), f"insult{i // 10 % 60}")
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 10 == 0)))
    frame, marks = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    held = "doc_id >= 2400"
    index = toxicity.train(frame, marks.where(f"not {held}"))
    rows = toxicity.score(frame.where(held), index).collect()
    caught = [r.toxicity >= 0.5 for r in rows if r.doc_id % 10 == 0]
    assert sum(caught) >= 0.8 * len(caught) and sum(r.toxicity >= 0.5 for r in rows if r.doc_id % 10) <= 6
    assert all(r.examples for r in rows)


def test_texts_without_evidence_are_few(spark):
    rows = queries.queries()["op2_toxicity"](spark, SF_DIR.replace("0.001", "0.01")).collect()
    without = sum(not r.examples for r in rows) / len(rows)
    print(f"share of texts without evidence: {without:.4f}")
    assert without < 0.01


def test_toxicity_on_odd_rows(spark, odd, none):
    docs, labels = toxic_docs(spark, 100)
    index = toxicity.train(docs, labels.union(spark.createDataFrame([(None, 1, 1), (3, None, 0), (5, 0, 0)], labels.schema)))
    out = toxicity.score(odd, index)
    assert out.columns.count("toxicity") == 1 and dict(out.dtypes)["toxicity"] == "double" and out.count() == len(ODD)
    assert extras_are_kept(out.collect(), "toxicity")
    assert toxicity.score(none, index).count() == 0
    empty = toxicity.train(docs, labels.limit(0))
    assert {r.toxicity < 0.5 for r in toxicity.score(odd, empty).collect()} == {True}


def brute_ppm(rows):
    """Method D with exclusion, by dictionaries; and the unigram baseline."""
    texts = {i: common.words(t, lower=True) for i, t, _ in rows}
    context, tally = {}, Counter()
    for i, _, learned in rows:
        if learned:
            tally.update([*texts[i], None])
            s = ppm.stream(texts[i])
            for k in range(ppm.ORDER, len(s)):
                for order in range(ppm.ORDER + 1):
                    context.setdefault(s[k - order : k], Counter())[s[k]] += 1
    n, v = sum(tally.values()), len(tally)
    out = {}
    for i, found in texts.items():
        s, total = ppm.stream(found), 0.0
        for k in range(ppm.ORDER, len(s)):
            excluded, done = set(), False
            for order in range(ppm.ORDER, -1, -1):
                seen = {b: c for b, c in context.get(s[k - order : k], {}).items() if b not in excluded}
                size = sum(seen.values())
                if seen and s[k] in seen:
                    total += math.log10((2 * seen[s[k]] - 1) / (2 * size))
                    done = True
                    break
                if seen:
                    total += math.log10(len(seen) / (2 * size))
                excluded |= set(seen)
            if not done:
                total -= math.log10(256 - len(excluded))
        base = sum(math.log10((tally[w] + 1) / (n + v + 1)) for w in [*found, None])
        out[i] = (len(found) + 1, sum(tally[w] > 0 for w in [*found, None]), n, base, total)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 2000])
def test_scores_equal_brute_force(spark, small, block_bytes):
    rows = [(i, t, i % 7 != 2) for i, t in small]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, learned boolean")
    want = brute_ppm(rows)
    for r in ppm.score(docs, "learned", block_bytes=block_bytes).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:], rel=1e-5)


def test_probabilities_of_all_bytes_sum_to_one():
    parts = [ppm.stream(common.words(t)) for t in ("abra cadabra", "abraxas", "banana band")]
    runs, counts = np.unique(ppm.runs(parts, np.zeros(3, np.int64)) >> np.uint64(16), return_counts=True)
    low = ppm._summed(ppm._shorter(runs, ppm.ORDER, 2), counts)
    trie = ppm.Trie(runs, counts, *low)
    for context in np.unique(runs >> np.uint64(8)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1)


def test_scores_on_odd_rows(spark, odd, none):
    marked = odd.selectExpr("*", "coalesce(doc_id % 3 <> 0, null) as learned")
    rows = ppm.score(marked, "learned").collect()
    assert len(rows) == len(ODD) and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)
    assert extras_are_kept(rows, "score")
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert ppm.score(none.selectExpr("*", "true as learned"), "learned").count() == 0
    unlearned = ppm.score(odd.selectExpr("*", "false as learned"), "learned").where("doc_id = 5").first()
    assert (unlearned.train_tokens, unlearned.n_known, unlearned.base_score) == (0, 0, 0.0)
    assert unlearned.score == pytest.approx(-8 * math.log10(256))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("fold", common.fold("doc_id", 4))
    model = language_id.train(docs.where("fold <> 2"))
    rows = language_id.identify(docs, model).where("fold = 2").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_languages_are_learned_from_whole_texts(spark):
    rng = random.Random(14)

    def prose(letters: str, n: int) -> str:
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))

    # Pages of one language open with a long header in the letters of the other.
    docs = [(i, prose("abcdefg", 200) + " " + prose("nopqrst", 400), "xx") for i in range(30)]
    docs += [(100 + i, prose("abcdefg", 600), "yy") for i in range(30)]
    model = language_id.train(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    asked = spark.createDataFrame([(1, prose("nopqrst", 30)), (2, prose("abcdefg", 30))], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(asked, model).collect()} == {1: "xx", 2: "yy"}


def test_every_language_is_learned_and_budgets_hold(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = [(100 * k + i, " ".join([letters[k % 26] + letters[k // 26] * 2] * 30), f"l{k:02d}") for k in range(70) for i in range(2 if k < 60 else 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = language_id.train(frame)
    assert [a.language for a in model.automata] == [f"l{k:02d}" for k in range(70)]
    assert language_id.fitting([(1, 50), (2, 70), (3, 30)], 90) == [1, 3] and language_id.fitting([(1, 50), (2, 40)], 30) == [2]


def test_automata_hold_moves_of_their_own_letters():
    """An automaton that every task holds has columns for the letters of its text, not for those of all languages."""
    classes, alphabet = language_id.letter_classes(["abcdefghijklmnopqrstuvwxyz"], 62)
    codes = language_id.codes("abba abba", classes)
    found = language_id.automaton("x", codes, alphabet)
    assert alphabet > 40 and len(found.moves) <= 2 * (len(codes) + 1) * 4


def test_phrases_are_the_longest_matches():
    rng = random.Random(12)
    for _ in range(20):
        text = "".join(rng.choices("abc", k=60))
        model = language_id.Model(*language_id.letter_classes([text + "d"], 10), [])
        automaton = language_id.automaton("x", language_id.codes(text, model.classes), model.alphabet)
        texts = ["".join(rng.choices("abcd", k=rng.randint(1, 40))) for _ in range(10)]
        model.automata.append(automaton)
        cost, _ = language_id.costs(texts, model, 1000)
        for t, c in zip(texts, cost[:, 0]):
            phrases, at = 0, 0
            while at < len(t):
                n = 1
                while at + n < len(t) and t[at : at + n + 1] in text:
                    n += 1
                at, phrases = at + n, phrases + 1
            assert round(c * len(t) / automaton.cost) == phrases


def test_language_on_odd_rows(spark, odd, none):
    docs = spark.createDataFrame([(1, "the and of with", "en"), (2, "der die und das", "de"), (3, None, "fr"), (4, "le la", None)], "doc_id bigint, text string, lang string")
    model = language_id.train(docs)
    out = language_id.identify(odd, model)
    assert out.columns.count("lang_pred") == 1 and {r.lang_pred for r in out.where("doc_id < 5").collect()} == {"und"}
    assert {r.lang_pred for r in out.where("doc_id >= 5").collect()} <= {"en", "de"} and out.count() == len(ODD)
    assert all(0 <= r.lang_score <= 1 for r in out.collect()) and extras_are_kept(out.collect(), "lang_pred")
    assert language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(docs.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("block,file", [(1 << 20, 1 << 25), (7, 1 << 25), (50, 300)])
def test_token_counts_over_block_and_file_boundaries(spark, small, small_docs, block, file):
    from colweave.llm.tokens import encoder

    folder = common.scratch(spark, "flat-test")
    manifest = token_counts.write_flat(small_docs, folder, tokenizer_path(), END_OF_TEXT, file_tokens=file)
    scanned = token_counts.scan(spark, folder, END_OF_TEXT, block_tokens=block)
    encode = encoder(tokenizer_path(), True)
    assert {r.doc_id: r.n_tokens for r in manifest.join(scanned, ["file", "number"]).collect()} == {i: len(encode(t)) for i, t in small}
    assert scanned.where("not ended").count() == 0


def test_flat_files_without_a_last_separator(spark, tmp_path):
    for name, ids in (("a", [5, 9, 9, 3, 4, 4]), ("b", [1, 2, 3]), ("c", [9]), ("d", [])):
        np.array(ids, "<u4").tofile(tmp_path / name)
    for block in (1, 2, 4, 100):
        rows = token_counts.scan(spark, str(tmp_path), 9, dtype="<u4", block_tokens=block).collect()
        got = sorted((r.file, r.number, r.start, r.n_tokens, r.ended) for r in rows)
        assert got == [("a", 0, 0, 1, True), ("a", 1, 2, 0, True), ("a", 2, 3, 3, False), ("b", 0, 0, 3, False), ("c", 0, 0, 0, True)]


def test_token_counts_on_odd_rows(odd, none):
    rows = token_counts.count_tokens(odd, tokenizer_path(), END_OF_TEXT).collect()
    got = Counter((r.doc_id, r.n_tokens) for r in rows)
    assert len(rows) == len(ODD) and got[1, 0] == got[2, 0] == 1 and got[6, 2] == 2
    assert [n for (i, n) in got if i == 10][0] > 6  # the special token's string is ordinary text
    assert token_counts.count_tokens(none, tokenizer_path(), END_OF_TEXT).count() == 0


def test_fast_ids_equal_the_library(small):
    from tokenizers import Tokenizer

    from colweave.llm.tokens import encoder

    slow, fast = Tokenizer.from_file(tokenizer_path()), encoder(tokenizer_path())
    texts = [t for _, t in small] + [t for _, t in ODD if t] + ["  a  b\n\n\tc ", " " * 5000 + "x", "é" * 3000, "a" * 20_000, "   x", "I'm we'll IT'S 3rd ½"]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_neighbours_reach_recall_and_break_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    data = [(i, (centres[i % 20] + rng.normal(size=16) * 0.6).tolist()) for i in range(3000)]
    data += [(10_000 + i, data[50][1]) for i in range(900)]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    s = ann.Settings(list_rows=100, part_rows=150)
    index = ann.build(frame, settings=s)
    assert len(index.centroids) > 20
    rows = ann.search(frame, frame.where("vec_id % 50 = 0"), index, settings=s).collect()
    ids = np.array([i for i, _ in data])
    vectors = np.array([v for _, v in data], np.float32).astype(float)
    hit = every = 0
    for q in sorted({r.query_id for r in rows}):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        c = ann.cosines(vectors, vectors[ids == q][0])
        c[ids == q] = -2
        best = np.lexsort((ids, -c))[:5]
        assert [r.score for r in own] == [c[ids == r.vec_id][0] for r in own]
        if q == 50 or q >= 10_000:
            assert [r.vec_id for r in own] == ids[best].tolist()
        hit, every = hit + len(set(ids[best].tolist()) & {r.vec_id for r in own}), every + 5
    assert hit / every >= 0.9


def neighbour_recall(spark, data, settings):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    index = ann.build(frame, settings=settings)
    found = {}
    for r in ann.search(frame, frame.where("vec_id % 50 = 0"), index, settings=settings).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(data), 50):
        c = ann.cosines(data, data[q])
        c[q] = -2
        hit += len(found[q] & set(np.argsort(-c)[:5].tolist()))
    return hit / (5 * len(range(0, len(data), 50))), len(index.centroids)


def test_neighbours_in_clusters_far_apart(spark):
    """Clusters that the graph of centroids does not link are reached."""
    rng = np.random.default_rng(2)
    data = rng.normal(size=(4, 16))[np.arange(3000) % 4] + 0.02 * rng.normal(size=(3000, 16))
    recall, lists = neighbour_recall(spark, data, ann.Settings(list_rows=20))
    assert lists > 4 * 25 and recall >= 0.9


def test_neighbours_in_few_dimensions(spark):
    """A query near one centroid has neighbours in lists far beyond the ratio."""
    recall, lists = neighbour_recall(spark, np.random.default_rng(3).normal(size=(3000, 6)), ann.Settings(list_rows=40))
    assert lists > 50 and recall >= 0.9


@pytest.mark.parametrize("copies,part_rows", [(2, 2000), (7, 50)])
def test_neighbours_of_repeated_rows(spark, copies, part_rows):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    frame = spark.createDataFrame([r for r in data for _ in range(copies)], "vec_id bigint, embedding array<float>")
    s = ann.Settings(list_rows=100 * copies, search_ratio=3.0, part_rows=part_rows)
    rows = ann.search(frame, frame.where("vec_id % 50 = 0"), ann.build(frame, settings=s), settings=s).collect()
    vectors = np.array([v for _, v in data], np.float32).astype(float)
    for q in range(0, 300, 50):
        c = ann.cosines(vectors, vectors[q])
        c[q] = -2
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [(r.rank, r.vec_id) for r in own] == list(enumerate(np.argsort(-c)[:5].tolist(), 1))


def test_neighbours_take_further_lists(spark):
    rng = np.random.default_rng(6)
    lonely = [1.0] + [0.0] * 7
    data = [(0, lonely)] * 200 + [(1, [1.0, 0.01] + [0.0] * 6)] * 200 + [(i, [-1.0, *rng.normal(size=7).tolist()]) for i in range(2, 600)]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    s = ann.Settings(list_rows=50)
    index = ann.build(frame, settings=s)
    rows = ann.search(frame, frame.where("vec_id = 0"), index, settings=s).collect()
    assert len(index.centroids) > 4 and sorted(r.rank for r in rows) == [1, 2, 3, 4, 5]
    assert min(rows, key=lambda r: r.rank).vec_id == 1 and len({r.vec_id for r in rows}) == 5
    few = frame.where("vec_id < 4")
    assert {r.vec_id for r in ann.search(few, few.where("vec_id = 0"), ann.build(few, settings=s), settings=s).collect()} == {1, 2, 3}


def test_neighbours_on_odd_vectors(spark):
    bad = [(50, None), (100, []), (150, [0.0, 0.0]), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (350, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (400, [2.0, 0.0])]
    schema = "vec_id bigint, embedding array<float>, rank int, list string"
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in bad + good], schema)
    rows = ann.search(frame, frame.where("vec_id % 50 = 0"), ann.build(frame)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in rows) == [
        (0, 1, 1, 1.0), (0, 2, 400, 1.0), (0, 3, 2, 0.0), (400, 1, 0, 1.0), (400, 2, 1, 1.0), (400, 3, 2, 0.0),
    ]
    assert ann.build(frame.limit(0)) is None and ann.search(frame, frame, None).count() == 0


def test_neighbours_of_huge_and_tiny_vectors(spark):
    """Components whose squares leave the range of doubles take part like all others, with the same cosines."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 8))
    scales = [1.0, 2.0**600, 2.0**-600, 2.0**1000, 2.0**-1000]
    rows = [(i, (base[i] * scales[i % 5]).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    plain = spark.createDataFrame([(i, base[i].tolist()) for i in range(60)], "vec_id bigint, embedding array<double>")
    answers = [
        sorted(map(tuple, ann.search(f, f.where("vec_id % 7 = 0"), ann.build(f)).collect())) for f in (frame, plain)
    ]
    assert answers[0] == answers[1] and len(answers[0]) == 45 and all(-1 <= r[3] <= 1 + 1e-12 for r in answers[0])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(i, i) for i in range(3)] + [(None, 4)]
    pairs += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    nodes = [(i,) for i in range(340)]
    root = list(range(340))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = common.components(spark.createDataFrame(nodes, "id bigint"), spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in range(340)}


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    from colweave.llm import decontaminate

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame([(100_001, "!!! 12", "en", "s", 6), (100_002, None, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns, frames = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(common.stored(stage(spark, frames[-1], SF_DIR), "stage"))
    assert all(f.columns == columns for f in frames[1:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert ids[0] - ids[1] == {100_001, 100_002} and ids[2] < ids[1] and ids[4] < ids[3] and ids[5] == ids[4]
    indexes = decontaminate.build_indexes(spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))
    assert decontaminate.find_leaks(frames[4], indexes).where("size(leaks) > 0").count() == 0
    texts = [r.text for r in frames[2].collect()]
    every = [common.words(t) for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in every for i in range(len(w) - 34))
    left = {r.doc_id: r.text for r in frames[3].collect()}
    for r, w in zip(frames[2].collect(), every):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        assert (left.get(r.doc_id) == (kept if gone.any() else r.text)) if kept or not gone.any() else r.doc_id not in left


def test_pipeline_keeps_one_row_of_every_group(spark):
    import corpus_pipeline

    rng = random.Random(21)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(9)]
    near = texts[4].rsplit(" ", 1)[0] + " changed"
    rows = [(1, texts[0]), (1, texts[0])]  # a repeated row
    rows += [(2, texts[1]), (None, texts[1])]  # a copy without an id
    rows += [(None, texts[2]), (None, texts[2])]  # copies without an id alone
    rows += [(3, texts[3]), (7, texts[3]), (7, texts[5])]  # one id, a copy and a text of its own
    rows += [(8, texts[4]), (None, near), (8, near)]  # near copies sharing an id
    rows += [(9, texts[6]), (None, texts[7]), (10, texts[8]), (11, texts[8])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = common.stored(dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, SF_DIR), "stage")
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(i or 0 for i, _ in kept) == [0, 0, 1, 2, 3, 7, 8, 9, 10]
    assert {t if t != near else texts[4] for _, t in kept} == set(texts) and left.columns == docs.columns
    after = dict(corpus_pipeline.STAGES)["substring_dedup"](spark, left, SF_DIR).collect()
    assert sorted((r.doc_id or 0, r.text) for r in after) == sorted((i or 0, t) for i, t in kept)


def test_pipeline_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    kinds = ", ".join(f"`{name}` {kind}" for name, (kind, _) in EXTRA.items())
    rows = [(i, t, "en", "s", len(t or ""), *(v for _, v in EXTRA.values())) for i, t in [*ODD, (20, "the cat of the house and the dog"), (20, "the cat of the house and the dog")]]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {kinds}")
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.stored(stage(spark, frame, SF_DIR), "stage")
        assert frame.dtypes == docs.dtypes and extras_are_kept(frame.collect())
        none = stage(spark, docs.limit(0), SF_DIR)
        assert none.columns == docs.columns and none.count() == 0
    assert [r.doc_id for r in frame.collect()].count(20) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR).where("start = 0").count() == frame.count()


def test_rows_without_an_id_are_spread_over_blocks(spark):
    rows = spark.range(100_000).selectExpr("cast(null as bigint) as doc_id", "concat('text ', id) as text")
    sizes = [r["count"] for r in rows.groupBy(common.block_of([rows.doc_id, rows.text], 16)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.2 * 100_000 / 16


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
