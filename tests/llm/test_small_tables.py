"""Edge cases of every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.llm import html_blocks, html_extraction, language_id, sentence_pieces, shingles, source_mix, token_counts, warc_bundles
from tablescout.llm.ngram_join import RTree, components, near_groups, needed, prefix
from tablescout.llm.two_pass_shuffle import two_pass_shuffle
from tablescout.llm.va_file import index_files, va_topk
from tablescout.llm.vantage_points import build_tree, index_trees, search_tree, vp_topk
from tablescout.llm.vector_grid import best_rows

public = pytest.importorskip("public_tokenizers")
BPE, PIECES = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = ["a", "the ", "  ", "\n", " ", "é", "'s", "<|endoftext|>", "梦", "😀", "12", ".", "\t", "ñ", "▁", "<0x0A>", "\x1c", "\x85", "zz"]


def odd_texts(n, seed, longest=40):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, longest))) for _ in range(n)]


# ---- token counts


def test_pieces_encode_like_the_whole_text():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    for text in odd_texts(60, 1, 400) + ["", "x" * 3000 + " " + "1a" * 500]:
        want = len(whole.encode(text, add_special_tokens=False))
        assert "".join(token_counts.safe_pieces(text, 100)) == text
        assert sum(len(whole.encode(p, add_special_tokens=False)) for p in token_counts.safe_pieces(text, 100)) == want
        assert token_counts.count_tokens([text], BPE) == [want]


def test_calls_are_balanced_by_bytes():
    sizes = np.array([5, 900, 40, 60, 1000, 3, 3])
    calls = token_counts.byte_balanced(sizes, 1000)
    assert sorted(np.concatenate(calls).tolist()) == list(range(7)) and max(sizes[c].sum() for c in calls) <= 1900
    assert token_counts.byte_balanced(np.zeros(0, np.int64)) == []


def test_token_counts_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "y"), (3, "hello world", "y"), (4, "word " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, BPE).collect()}
    assert got == {(1, 0, 0, False), (2, 0, 0, False), (3, 11, 2, False), (4, 250_000, 50_001, True)}
    assert token_counts.token_counts(df.limit(0), BPE).collect() == []
    library = __import__("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    model = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, PIECES).collect()}
    assert model == {i: len(library.encode(t or "")) for i, t, _ in rows}


# ---- language identification


def test_language_model_edges(spark):
    words = {"en": ["the", "house", "with", "stone"], "de": ["der", "straße", "schön", "und"]}
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(words[lang]) for _ in range(12)), lang, "hot") for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(900, None, "en", None), (901, "", "de", None), (902, "123 !!", None, None), (903, "the stone house", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.train(df, max_rows=80)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, model).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "en" and 0.5 < got[903][1] <= 1
    assert sum(got[i][0] == lang for i, _, lang, _ in rows[:120]) >= 118
    assert (model.weights == 0).mean() > 0.5  # the l1 penalty keeps unused weights at exactly zero
    none = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).collect() == []


# ---- html


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><a href=1>One</a></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Title &amp; more</h1><p>First   line with <a href=x>a link</a>
inside it, and more words.<p><b>Second, unclosed.<br>still second<div class="ad">Buy now</div><p>Third&nbsp;one.</article>
<section id="comments"><p>I liked it, thanks.</p></section><footer>&copy; me</footer>"""


def test_page_blocks():
    texts = [b.text for b in html_blocks.page_blocks(PAGE)]
    assert texts == ["One", "We use cookies.", "Title & more", "First line with a link inside it, and more words.",
                     "Second, unclosed. still second", "Buy now", "Third one.", "I liked it, thanks.", "© me"]
    assert html_blocks.page_blocks(None) == html_blocks.page_blocks("") == html_blocks.page_blocks("<p> </p>") == []


@pytest.mark.parametrize("page,texts", [
    ("<html><head><title>x</title><article><p>Text.</p>", ["Text."]),
    ("<html><head><meta charset=a><script>no()</script><span>Text</span> on.<p>More.", ["Text on.", "More."]),
    ("<head><style>p{}</style>Bare text.<p>More.", ["Bare text.", "More."]),
    ("<head><noscript><p>no</p></noscript><title>x</title></head><body><p>Text.</p>", ["Text."]),
    ("<p>One <svg><title>t</title><path/><text>no</text></svg> two.</p>", ["One two."]),
    ("<p>One <script>if (a) { b() }</script>two<style>i{}</style> three.</p><p>Four.</p>", ["One two three.", "Four."]),
    ("<p>One <noscript><p>no</p></noscript>two.</p><p>Three.</p>", ["One two.", "Three."]),
    ("<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>", ["As x=2 holds."]),
    ("<p>One<svg><path><p>Two.", ["One", "Two."]),
    ("<p>One <svg><foreignObject><div>no</div></foreignObject></svg>two.</p>", ["One two."]),
    ("<div>One<svg></div><div>Two</div>", ["One", "Two"]),
])
def test_page_blocks_of_open_heads_and_inline_silence(page, texts):
    assert [b.text for b in html_blocks.page_blocks(page)] == texts


def test_gradients_match_differences():
    draw = np.random.default_rng(3)
    net = html_extraction.BiLSTM(1, width=5, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = draw.normal(size=(4, 2, 5)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y, weight = draw.integers(0, 2, (4, 2)).astype(float), mask.astype(float)

    def loss():
        z = net.logits(x, mask)
        return (weight * (np.log1p(np.exp(z)) - y * z)).sum() / weight.sum()

    grads = net.gradients(x, mask, y, weight)
    for name, at in (("xf", (1, 2)), ("hb", (0, 5)), ("cf", (4,)), ("o", (2, 0))):
        keep, step = net.p[name][at], 1e-3
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-3


def test_extraction(spark):
    prose = ["A first sentence of prose, long enough to read.", "Another one follows here, with more words.", "And a third sentence ends it."]
    rows = [(i, f"u{i}", PAGE.replace("Title", prose[i % 3])) for i in range(30)] + [(90, None, None), (91, "", ""), (92, "x", "<div></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    model = html_extraction.train(df, max_pages=25)
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(df, model).collect()}
    assert got[90] == got[91] == got[92] == ("", 0)
    want = "\n\n".join([prose[0] + " & more", "First line with a link inside it, and more words.", "Second, unclosed. still second", "Third one."])
    assert got[0] == (want, len(want))
    assert html_extraction.extract(df.limit(0), html_extraction.train(df.limit(0))).collect() == []


def test_roles_are_named_by_whole_ways():
    label = lambda path: html_extraction.path_label(tuple(path.split()))
    for path in ("html body div .page article p", "html body div .site main p", "html body div .article .body p",
                 "html body div .post .body p", "html body form article p", "html body article header h1",
                 "html body div .site div .entry .content p"):
        assert label(path) == 1.0, path
    for path in ("html body nav ul li", "html body header h1", "html body header .site .header p", "article div .comment .body p",
                 "article aside p", "html body div .page div .ad p", "html body div .sidebar .content p", "div .footer form p"):
        assert label(path) == 0.0, path
    for path in ("html body div .page p", "html body div .site div .body p", "html body form div p", "article form label",
                 "html body ol .list li", "article div .post .footer p"):
        assert label(path) is None, path


LAYOUTS = ['<div id="page">{top}<article>{head}{text}</article>{end}</div>', '{top}<div class="article-body">{head}{text}</div>{end}',
           '<form id="aspnetForm">{top}<article>{head}{text}</article>{end}</form>', '{top}<article><header>{head}</header>{text}</article>{end}',
           '<div class="site">{top}<div class="post-body">{head}{text}</div>{end}</div>']


def test_extraction_of_ordinary_layouts(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n)).capitalize() + "."
    rows, want = [], {}
    for i in range(60):
        head, text = say(6), [say(draw.randint(12, 40)) for _ in range(5)]
        parts = {"head": f"<h1>{head}</h1>", "text": "".join(f"<p>{t}</p>" for t in text), "top": "<nav><ul><li><a href=1>Home</a></li></ul></nav>",
                 "end": f'<div class="sidebar"><p>{say(3)}</p></div><footer><p>Imprint</p></footer>'}
        rows.append((i, f"<html><head></head><body>{LAYOUTS[i % 5].format(**parts)}</body></html>"))
        want[i] = "\n\n".join([head, *text])
    df = spark.createDataFrame(rows, "page_id long, html string")
    model = html_extraction.train(df.where("page_id < 40"), max_pages=40)
    got = {r.page_id: r.text for r in html_extraction.extract(df, model).collect()}
    assert {i: got[i] for i in range(40, 60)} == {i: want[i] for i in range(40, 60)}


def test_all_blocks_of_a_sampled_page_are_learned(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(html_extraction.BiLSTM, "fit", lambda self, pages, **_: learned.extend(len(p[1]) for p in pages))
    page = "<article>" + "<p>Some text.</p>" * 450 + "</article>"
    html_extraction.train(spark.createDataFrame([(1, page)], "page_id long, html string"), dressed=0)
    assert learned == [200, 200, 50]


# ---- archives


def test_bundles_are_seekable():
    writer = warc_bundles.BundleWriter(frame_bytes=500)
    payloads = [b"", b"x" * 2000, "é\r\n\r\n".encode(), b"same", b"same"]
    for i, p in enumerate(payloads):
        writer.add(*warc_bundles.make_record(i, "http://a\r\nb", p, 4 if i == 3 else None, "1970-01-01T00:00:00Z"))
    entries, archive = writer.entries, writer.finish()
    assert len(warc_bundles.seek_table(archive)) == len(writer.frames) > 1
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True).read()
    assert len(plain) == sum(e["length"] for e in entries)
    for i, (p, e) in enumerate(zip(payloads, entries)):
        record = warc_bundles.read_record(archive, e)
        assert record["page_id"] == i and record["payload_bytes"] == len(p)
        assert record["payload_digest"] == warc_bundles.sha1_base32(p)
        assert (record["record_type"], record["refers_to"]) == (("revisit", 4) if i == 3 else ("response", None))
        assert record["payload"] == (None if i == 3 else p)


def test_archive_round_trip(spark):
    rows = [(1, "a", None), (2, "b", ""), (5, "c", "hot")] + [(10 + i, None, "hot") for i in range(50)] + [(7, "d", "é" * 100_000), (59, "x", "hot"), (None, "n", "hot")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1))
    got = [tuple(r) for r in warc_bundles.read_bundles(warc_bundles.write_bundles(df)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    want = [(1, 0, "revisit", 2), (2, 0, "response", None), (5, 3, "revisit", 59), (None, 3, "revisit", 59), (7, 200_000, "response", None), (59, 3, "response", None)]
    want += [(10 + i, 3, "revisit", 59) if i < 49 else (59, 3, "response", None) for i in range(50)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc_bundles.read_bundles(warc_bundles.write_bundles(df.limit(0))).collect() == []


# ---- mixing


def test_knapsack_is_nearest():
    draw = random.Random(1)
    for _ in range(200):
        lengths = sorted(draw.sample(range(1, 30), draw.randint(1, 5)))
        counts, budget = [draw.randint(1, 3) for _ in lengths], draw.randint(0, 60)
        best = min(abs(sum(n * k for n, k in zip(lengths, ks)) - budget) for ks in itertools.product(*[range(c + 1) for c in counts]))
        fit = source_mix._knapsack([(i, n, c) for i, (n, c) in enumerate(zip(lengths, counts))], budget)
        assert all(k <= counts[i] for i, k in fit.items())
        assert abs(sum(lengths[i] * k for i, k in fit.items()) - budget) == best
        assert all(0 <= t <= c for t, c in zip(source_mix.fit_counts(lengths, counts, budget, 10), counts))


def poured(totals, weights=(3.0, 1.0, 2.0)):
    """Targets by resharing step by step."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, goal, open_ = 1.5 * sum(totals.values()), dict.fromkeys(names, 0.0), set(names)
    while open_ and left > 1e-9:
        share, full = left / sum(w[s] for s in open_), set()
        for s in open_:
            goal[s] += share * w[s]
        left = 0.0
        for s in open_:
            if goal[s] > 2 * totals[s]:
                left += goal[s] - 2 * totals[s]
                goal[s] = 2.0 * totals[s]
                full.add(s)
        open_ -= full
        if not full:
            break
    return goal


def test_mix(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.randint(0, 30)), draw.choice(["a", "a", "a", "b", "é", None, ""])) for i in range(400)]
    rows += [(1000 + i, "same text here", "a") for i in range(300)] + [(5000, None, "b"), (5001, "\t\n", "void"), (1000, "same text here", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = source_mix.mix(df).collect()
    assert len(out) == len(rows)
    totals, taken = {}, {}
    for r in out:
        totals[r.source] = totals.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.size == len((r.text or "").split()) and r.taken in (0, r.size, 2 * r.size)
    goals = poured(totals)
    for r in out:
        assert r.source_size == totals[r.source] and abs(r.target - goals[r.source]) < 1e-6 * max(1, goals[r.source])
    assert all(abs(taken[s] - goals[s]) <= 1 for s in goals)
    again = source_mix.mix(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    assert source_mix.mix(df.limit(0)).collect() == []


# ---- piece encoding


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentence_pieces.piece_model(PIECES)
    for text in odd_texts(400, 5) + ["", " ", "a" * 500, "Grüße aus München. 你好"]:
        ids = own.encode(text).tolist()
        assert ids == library.encode(text) and own.decode(ids) == library.decode(ids)
    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (4, "lorem ipsum " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece_ids", F.lit(0))
    out = {r.doc_id: r for r in sentence_pieces.encode_pieces(df, PIECES, check="same").collect()}
    assert out[1].piece_ids == out[2].piece_ids == [] and all(r.same for r in out.values())
    assert out[4].piece_ids == library.encode(rows[4][1])
    back = {r.doc_id: r.decoded for r in sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(df, PIECES), PIECES).collect()}
    assert back == {1: "", 2: "", 3: "two words", 4: rows[4][1]}
    assert sentence_pieces.encode_pieces(df.limit(0), PIECES).collect() == []


def test_unigram_files_get_the_best_path():
    with open(PIECES, "rb") as f:
        data = f.read()
    at = data.index(b"\x18\x02 \x80\xfa\x01")  # model type and vocabulary size of the trainer's record
    model = sentence_pieces.PieceModel(data[:at] + b"\x18\x01" + data[at + 2 :])
    assert model.kind == sentence_pieces.UNIGRAM

    def best(text):
        scores = [0.0] + [-float("inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                if (i := model.ids.get(text[start:end])) is not None:
                    scores[end] = max(scores[end], scores[start] + model.scores[i])
        return scores[-1]

    for text in ("▁the", "▁international", "▁tion", "▁heating", "▁wording"):
        ids = model._encode_stretch(text)
        assert "".join(model.pieces[i] for i in ids) == text
        assert abs(sum(model.scores[i] for i in ids) - best(text)) < 1e-3


# ---- shingles and the Jaccard join


def plain_set(text, words):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return set() if not w else {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def plain_groups(rows, words, percent):
    sets = {i: plain_set(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_shingle_sets_have_the_sizes_of_plain_ones():
    for text in odd_texts(200, 6, 80) + [None, "", "one", "ONE one", "é É", "a b c d e a b c d e", "x" * 3000 + " y"]:
        for words in (1, 3, 5):
            assert len(shingles.shingle_set(text, words)) == len(plain_set(text, words))
    assert shingles.set_key(shingles.shingle_set("A b", 4)) == shingles.set_key(shingles.shingle_set("a\tB ", 4))


def test_prefix_keeps_common_shingles_last():
    s = np.arange(1, 101, dtype=np.uint64)
    got = prefix(s, np.arange(1, 51, dtype=np.uint64), 85)
    assert len(got) == 100 - 85 + 1 and got.min() == 51


def near_copies(seed, families, size):
    draw = random.Random(seed)
    rows, n = [], 0
    for _ in range(families):
        base = [f"w{draw.randint(0, 5000)}" for _ in range(draw.randint(1, 120))]
        for _ in range(draw.randint(1, size)):
            words = list(base)
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(len(words))] = f"v{draw.randint(0, 5000)}"
            rows.append((n, " ".join(words)))
            n += 1
    return rows


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_groups_equal_brute_force(spark, words, percent):
    rows = near_copies(words, 40, 12) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "short"), (9004, "Short ")]
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(9100 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(3 + i % 40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("h", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, words, percent).collect()}
    assert got == plain_groups(rows, words, percent)


def test_groups_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_groups(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "alone one"), (7, "other text")]
    got = sorted(((r.doc_id, r.component_id) for r in near_groups(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None), (7, 7)], key=str)


def test_groups_of_near_copies_without_ids_and_of_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    changed = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(base))
    rows = [(5, changed()), (None, changed(0)), (3, changed(0, 59)),  # 5 ~ null ~ 3, 5 and 3 are too far apart
            (20, "first text of twenty"), (20, "second text of twenty"), (11, "first text of twenty"), (25, "second text of twenty"), (20, None),
            (None, "lone " + changed(7)[::-1]), (None, "lone " + changed(7)[::-1] + " more")]
    found = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 84).collect()
    got = sorted(((r.doc_id, r.component_id) for r in found), key=str)
    assert got == sorted([(5, 3), (None, 3), (3, 3), (20, 11), (20, 11), (11, 11), (25, 11), (20, 11), (None, None), (None, None)], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 9)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 100) for i in range(100, 161)} | {(5, 5), (9, 5)}


def test_tree_search_equals_a_scan():
    draw = np.random.default_rng(8)
    base = draw.integers(0, 6, (12, 16))
    points = np.maximum(base[draw.integers(0, 12, 400)] + draw.integers(-1, 2, (400, 16)), 0)
    sizes, parts = points.sum(axis=1), draw.integers(0, 5, 400)
    tree = RTree(points, sizes, parts)
    for i in range(0, 400, 7):
        ok = (np.minimum(points, points[i]).sum(axis=1) >= needed(sizes[i], sizes, 85)) & (parts != parts[i])
        ok &= (100 * sizes >= 85 * sizes[i]) & (85 * sizes <= 100 * sizes[i])
        assert sorted(tree.search(points[i], sizes[i], parts[i], 85).tolist()) == np.flatnonzero(ok).tolist()


# ---- shuffle


def test_shuffle_law(spark):
    rows = [(i, "x" * (i % 50)) for i in range(997)] + [(5, "x" * 5)] * 4 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    run = lambda seed: two_pass_shuffle(df, 7, F.coalesce(F.length("text"), F.lit(0)), seed, bucket_bytes=4000).collect()
    out = run(1)
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(rows, key=str)
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    key = lambda rows: sorted((r.shard, r.slot, str(r.doc_id)) for r in rows)
    assert key(out) == key(run(1)) != key(run(2))
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.15
    assert two_pass_shuffle(df.limit(0), 7, F.lit(1)).collect() == []
    assert {(r.shard, r.slot) for r in two_pass_shuffle(df.limit(3), 24, F.lit(1)).collect()} == {(0, 0), (1, 0), (2, 0)}


# ---- vector searches


def brute(rows, k, every):
    best, out = {}, {}
    for i, v in rows:
        best[i] = min(best.get(i, v), v)
    for q in sorted(best):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(best[q], v)), i) for i, v in best.items() if i != q and len(v) == len(best[q]))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vector_rows(seed, n, dim, whole):
    draw = random.Random(seed)
    value = (lambda: draw.randint(-30, 30)) if whole else (lambda: draw.gauss(0, 1))
    rows = [(i, [value() for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, list(rows[0][1])) for i in range(30)] + [(3, rows[3][1])] + [(2000, [value() for _ in range(dim + 1)]), (2010, [value() for _ in range(dim + 1)])]
    return rows


@pytest.mark.parametrize("shard_rows,block_rows", [(64, 16), (10_000, 10_000)])
def test_va_file_is_exact(spark, shard_rows, block_rows):
    rows = vector_rows(9, 400, 8, True) + [(5000, [2**40] * 8), (5010, [-(2**40)] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    asked = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in va_topk(asked, index_files(df, shard_rows), 5, block_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 5, 10)
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = {q: [(i, hold(s)) for i, s in r] for q, r in want.items() if r}
    assert {q: [s for _, s in r] for q, r in got.items()} == {q: [s for _, s in r] for q, r in want.items()}
    assert {q: r for q, r in got.items() if q < 5000} == {q: r for q, r in want.items() if q < 5000}


def test_vantage_points_exact_and_relaxed(spark):
    rows = vector_rows(11, 400, 8, False)
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    asked = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    want = {q: r for q, r in brute(rows, 5, 10).items() if r}
    index = index_trees(df, 128)
    for relax, least in ((1.0, 1.0), (2.0, 0.9)):
        got = {}
        for r in vp_topk(asked, index, 5, relax, 16).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= least * sum(map(len, want.values()))
        if relax == 1.0:
            assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    empty = df.limit(0)
    assert vp_topk(empty.withColumnRenamed("vec_id", "query_id"), index_trees(empty), 5).collect() == []
    with pytest.raises(ValueError):
        vp_topk(asked, index, 5, 0.5)


def test_tree_prunes_low_dimensions():
    draw = np.random.default_rng(12)
    x = draw.normal(size=(3000, 3))
    order, nodes, shells = build_tree(x, leaf=32)
    row = {"n": 3000, "dim": 3, "ids": np.arange(3000)[order].tobytes(), "vectors": x[order].tobytes(), "nodes": nodes.tobytes(), "shells": shells.tobytes()}
    q = draw.normal(size=(20, 3))
    who, ids, scores = search_tree(row, np.arange(-20, 0), q, 7, 1.0)
    want = best_rows(q @ x.T, np.arange(3000), 7)[1]
    assert ids.reshape(20, 7).tolist() == want.tolist()


def test_hash_of_the_archive_digest():
    assert warc_bundles.sha1_base32(b"abc") == __import__("base64").b32encode(hashlib.sha1(b"abc").digest()).decode()
