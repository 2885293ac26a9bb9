"""Decontamination, BPE, token store, HTML text, classifiers against brute force, round trips and planted signals."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from fathomark.llm import bpe, decontaminate, html_text, quality, token_store, toxicity

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return TOKEN.findall((text or "").translate(FOLD))


def brute_hits(docs, items, length=13):
    windows = {}
    for item, text in items:
        w = tokens(text)
        n = min(length, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault((n, tuple(w[k : k + n])), set()).add(item)
    out = []
    for i, text in docs:
        w, places, found = tokens(text), set(), set()
        for n in {n for n, _ in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get((n, tuple(w[k : k + n])))
                if own:
                    places |= set(range(k, k + n))
                    found |= own
        found.discard(None)
        ids = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((-1 if i is None else i, len(w), len(places), len(found), ids, len(places) > 0 and 20 * len(places) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def benchmark():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    long = [" ".join(word() for _ in range(n)) for n in (13, 20, 45)]
    return [(1, long[0]), (2, long[1].upper()), (10, long[2]), (11, "Tiny item"), (12, ""), (13, None), (None, long[0]), (14, long[0])]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 1])
def test_contamination_equals_brute_force(spark, docs, texts, benchmark, limit):
    extra = [
        (900, f"x y z {benchmark[0][1]} tail"), (901, benchmark[2][1].replace(" ", ", ").title()), (902, "a tiny ITEM here " + "pad " * 60), (903, f"{benchmark[1][1]} {benchmark[1][1]}"),
        (904, " ".join(benchmark[1][1].split()[3:18])), (905, " ".join(benchmark[1][1].split()[:12])), (None, f"q {benchmark[0][1]}"),
    ]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    got = decontaminate.contamination(both, items, broadcast_windows=limit).collect()
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert rows == brute_hits([*texts, *extra], benchmark)
    kept = decontaminate.drop_contaminated(both, items)
    assert kept.count() == sum(not r.contaminated for r in got) and kept.columns == both.columns
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(both, items).collect() if r.doc_id and r.doc_id >= 900}
    assert cut[900] == "x y z tail" and cut[905] == extra[5][1] and cut[903] == ""


def test_contamination_of_nothing(spark, docs, none, benchmark):
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
ODD = st.lists(st.sampled_from(list("aAbT 'sre19.,!?\n\t\x0b\x1c\x1f\x85\xa0 ßÉéΣσςİ́̊Å中한ﬁ²🙂‍\x00") + ["<|endoftext|>", "<|START", "don't", "aaaa"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    out = tokenizers.Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_bpe_equals_the_library(library, rows):
    encoder = bpe.Encoder(bpe.vocabulary(PATH), memory=20)
    own = token_store.LibraryEncoder(PATH, memory=20)
    for text, ids, stored in zip(rows, encoder.encode(rows), own.encode(rows, 1)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and stored.tolist() == [*want, 1]
        assert encoder.vocab.decode(ids) == library.decode(want, skip_special_tokens=False)


# Capitals with a mark whose composed form exists in lower case only, and a capital that lower-cases to two characters.
PAIRS = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "\u0130\u0323", "\u0130\u0307"]
MARKED = st.lists(st.sampled_from([*PAIRS, *"aJé ,.\u030c\u0331"]), max_size=20).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(MARKED, max_size=4))
@example(PAIRS)
@example([f"a{p}, {p}." for p in PAIRS])
def test_case_is_folded_after_composition(library, rows):
    own, encoder = token_store.LibraryEncoder(PATH, memory=20), bpe.Encoder(bpe.vocabulary(PATH), memory=20)
    for text, stored, ids in zip(rows, own.encode(rows, 1), encoder.encode(rows)):
        want = library.encode(text, add_special_tokens=False).ids
        assert stored.tolist() == [*want, 1] and ids.tolist() == want


def test_bpe_rows(docs, none, texts, library):
    got = bpe.encode(docs, PATH, decoded=True).collect()
    assert len(got) == len(texts)
    want = sorted((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids) for i, t in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in back) == sorted((r.doc_id or -1, r.decoded) for r in got)
    assert bpe.encode(none, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.lists(st.integers(0, 60000), max_size=5)), max_size=60))
def test_shard_finds_every_key_and_no_other(rows):
    rows.sort(key=lambda r: r[0])
    shard = token_store.Shard(token_store.pack([k for k, _ in rows], [np.array(v, np.uint32) for _, v in rows], 7, 2))
    first = {}
    for k, v in rows:
        first.setdefault(k, v)
    assert {k: shard.get(k).tolist() for k in first} == first
    assert all(shard.get(k) is None for k in (1, -5, 2**40) if k not in first)
    pilots, slots = token_store.perfect_hash(np.array(sorted(first), np.int64))
    assert sorted(slots.tolist()) == list(range(len(first))) and len(pilots) == max(1, -(-len(first) // token_store.BUCKET))


def test_library_encoder_sends_words_in_lines(library):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 1 + k % 9)) for k in range(3000)]
    odd = ["\u0130stanbul", "\u0130", "e\u0301t\u0301", "o\u0301", "\u03a3\u03a3", "\u1100\u1161", "\ufb01n", "\u00e9a$$$", "\u01c5x", "a\u0301!!", "\u2167", "x\u00b2", "\u0e33", "\u0640a"]
    marks = ["ab$$$", "AB,.", "a'", "'s", "x's'", "...", "a_b__", "a\x01!!", "9.5%", "a<|", "<|endoftext|>!", "a|>", "don't.", "5!!", "-a-"]
    texts = [" ".join(words[k : k + 300] + odd + marks) for k in range(0, 3000, 300)] + [" ".join(reversed(odd + marks)), None]
    encoder = token_store.LibraryEncoder(PATH)
    sent = []

    class Counted:
        def encode_batch_fast(self, parts, **options):
            sent.extend(parts)
            return library.encode_batch_fast(parts, **options)

    encoder.tokenizer = Counted()
    got = [row.tolist() for row in encoder.encode(texts, 1)]
    assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    # Lines with an odd word are encoded word by word; the others are sent as a whole.
    encoder.known.clear(), sent.clear()
    plain = [" ".join(words)]
    assert [row.tolist() for row in encoder.encode(plain, 1)] == [[*library.encode(plain[0], add_special_tokens=False).ids, 1]]
    assert len(sent) <= -(-len(words) // token_store.LINE_WORDS)


def test_store_and_read(spark, docs, none, texts, library, tmp_path):
    known = sorted((i, t or "") for i, t in texts if i is not None)
    got = token_store.store_and_read(docs, PATH, shard_tokens=500).collect()
    rows, at = [], 0
    for i, t in known:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        rows.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == sorted(rows)
    folder = str(tmp_path / "shards")
    token_store.write_shards(docs, folder, PATH, shard_tokens=500)
    found = {r.doc_id: r.ids for r in token_store.lookup(spark, folder, [3, 100, 77777]).collect()}
    assert found == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in known if i in (3, 100)}
    assert token_store.store_and_read(none, PATH).count() == 0


def test_html_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <article><header><h1>Head &amp; line</h1></header><p>One  <b>two</b>&nbsp;three<br>four<p>a &lt; b<div class="ad-slot">Buy</div><script>var x="<p>no</p>";</script><!-- <p>hidden</p> -->
    <p>End.</p><section id="comments"><p>nice</p></section></article><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\nOne two three four\na < b\nEnd."
    assert [html_text.main_text(x) for x in (None, "", "<p></p>", "plain", "a<b", "<div", "<p>x")] == ["", "", "", "plain", "a", "", "x"]
    body = "".join(f"<p>Sentence {k} of the story goes on for a while.</p>" for k in range(5))
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(6)) + "</ul>"
    out = html_text.main_text(f"<body>{menu}<div class=content>{body}</div><div class='sidebar'><p>Other things to read here.</p></div>{menu}</body>")
    assert out == "\n".join(f"Sentence {k} of the story goes on for a while." for k in range(5))


STORY = "".join(f"<p>Sentence {k} of the story goes on for a while.</p>" for k in range(5))
TOLD = "\n".join(f"Sentence {k} of the story goes on for a while." for k in range(5))


@pytest.mark.parametrize(
    "page",
    [
        f"<html class='no-cookie-consent'><body class='single has-sidebar comments-open'><article>{STORY}</article></body></html>",
        f"<div class='content with-sidebar'><article>{STORY}</article><div class='sidebar'><p>Other things to read.</p></div></div>",
        f"<section class='search-results-page'><div>{STORY}</div></section><footer>Foot</footer>",
        f"<div id='share-layout'>{STORY}<div class='share'><p>Pass it on</p></div></div>",
        f"<article class='post social-story'>{STORY}<section id='comments'><p>{'A long comment. ' * 60}</p></section></article>",
        f"<main class='with-sidebar'><article>{STORY}</article></main><div id='comments'><article class='comment'>{'Nice. ' * 20}</article><article class='comment'>{'Indeed. ' * 20}</article></div>",
        f"<div class='content'>{STORY}</div><div id='comments'><p>{'A comment that goes on. ' * 20}</p></div>",
        f"<script src=/a.js/>var x = '<p>no</p>';</script><article>{STORY}</article>",
        f"<body><div>{STORY}</div><noscript>",
    ],
)
def test_article_within_hinted_wrappers(page):
    assert html_text.main_text(page) == TOLD


def test_short_lead_and_ending_of_a_cut_article():
    cut = "".join(f"<div class='advert'><p>Buy {k}</p></div>" for k in range(4))
    page = f"<body><div class='top'><p>Tagline</p></div>{cut}<div class='content'><p>Lead.</p>{cut}{STORY}{cut}<p>End.</p></div></body>"
    assert html_text.main_text(page) == f"Lead.\n{TOLD}\nEnd."


def test_many_open_and_stray_tags_take_linear_time():
    n = 40_000
    assert html_text.main_text("<div>" * n + "<p>x</p>" + "</section>" * n + "<svg>" * n) == "x"
    assert html_text.main_text("<div class=sidebar>" * n + "<p>x</p>" + "</section>" * n) == "x"


def test_html_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", "<article><p>Ünï</p></article>", "clash", 9), (1, "u", "<article><p>Ünï</p></article>", "clash", 9), (2, None, None, None, None), (None, "v", "<p>" + "word " * 50_000 + "</p>", "x", 1)]
    got = sorted((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, "v", ("word " * 50_000).strip(), 249_999), (1, "u", "Ünï", 3), (1, "u", "Ünï", 3), (2, "", "", 0)]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    plain = lambda n: " ".join(rng.choice(["the", "of"]) if rng.random() < 0.3 else "".join(rng.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(900):
        text, toxic, good = plain(rng.randint(20, 80)), int(i % 5 == 0), int(i % 3 != 0)
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["wretched", "zqbog", "frumpish"]))
            text = " ".join(w)
        if not good:
            text = " ".join(f"{x}%%%" for x in text.split())
        rows.append((i, text, toxic))
        labels.append((i, good, toxic))
    labels += [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,folds,out", [(toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)])
def test_classifiers_on_held_out_rows(spark, docs, none, texts, labelled, module, label, folds, out):
    rows, labels = labelled
    model = module.fit(rows, labels)
    got = module.score(rows, model).join(labels.groupBy("doc_id").max(label).withColumnRenamed(f"max({label})", "y"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.y for r in held) >= 0.95 * len(held)
    # Labels of the held-out fold are never learned: turning them over changes nothing.
    turned = labels.selectExpr("doc_id", *(f"CASE WHEN crc32(cast(doc_id AS string)) % {folds} = {out} THEN 1 - {c} ELSE {c} END AS {c}" for c in ("quality", "toxic")))
    again = {r.doc_id: r.score for r in module.score(rows, module.fit(rows, turned)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in got)
    assert module.score(docs, model).count() == len(texts) and module.score(none, model).count() == 0
    blind = module.score(docs, module.fit(docs, labels.limit(0)))
    assert blind.select("score").distinct().count() == 1


def test_drop_toxic_keeps_columns(labelled):
    rows, labels = labelled
    model = toxicity.fit(rows, labels)
    kept = toxicity.drop_toxic(rows, model)
    gone = {r.doc_id for r in toxicity.score(rows, model).filter("predicted = 1").collect()}
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == set(range(900)) - gone


def test_words_of_chunks():
    from fathomark.llm.words import chunks, split_words

    texts = ["a bb\tccc", None, "", "dddddddddddddddd e", " x "]
    found = []
    for _, _, data, offsets in chunks(pa.array(texts), 6):
        flat = split_words(data, offsets)
        for a, b in zip(flat.first, flat.first[1:]):
            found.append(flat.join(np.arange(a, b)).decode())
    assert found == ["a bb ccc", "", "", "dddddddddddddddd e", "x"]
