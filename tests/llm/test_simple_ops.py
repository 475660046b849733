"""Media, pieces, languages, toxicity, html: texts in, values out."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from maskwright.llm import html, languages, media, pieces, toxicity
from pyspark.sql import functions as F

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, media string, key string"


def docs(spark, texts):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", "y") for i, t in enumerate(texts)], DOCS)


ODD = ["", None, "a", "a" * 5000, "é😀 x\x00y", "same", "same", "\t \n"]


# ---------------------------------------------------------------- media


@hypothesis_settings(max_examples=20, deadline=None)
@given(st.binary(max_size=2000))
def test_payload_round_trip(data):
    payload = media.pad(data)
    stored = media.encode_payload(payload)
    decoder = media.ProgressiveDecoder(stored)
    assert decoder.payload() == payload and payload[: len(data)] == data and len(payload) % 192 == 0 and payload
    assert decoder.rgb().shape == (decoder.height, decoder.width, 3)


def test_long_payload_spans_runs():
    payload = np.random.default_rng(0).integers(0, 256, 192 * 33_001, dtype=np.uint8).tobytes()
    assert media.ProgressiveDecoder(media.encode_payload(payload)).payload() == payload


class _Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def signed(self, value, n):
        self.put(value if value > 0 else value + (1 << n) - 1, n)


def _refine(writer, blocks, start, end, low):
    """AC refinement with symbols 0x00-0xff as 8-bit codes (0xff unused)."""
    for block in blocks:
        corrections, run = [], 0
        last = max([k for k in range(start, end + 1) if abs(int(block[k])) >> low == 1], default=-1)
        for k in range(start, end + 1):
            v = abs(int(block[k])) >> low
            if v == 0:
                run += 1
                continue
            while run > 15 and k <= last:  # sixteen zeros
                writer.put(0xF0, 8)
                writer.bits += corrections
                corrections, run = [], run - 16
            if v > 1:
                corrections.append(v & 1)
                continue
            writer.put(run << 4 | 1, 8)
            writer.put(1 if block[k] > 0 else 0, 1)
            writer.bits += corrections
            corrections, run = [], 0
        if run or corrections:  # end of this block's band
            writer.put(0x00, 8)
            writer.bits += corrections


@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)]])
def test_general_scans_and_chroma_upsampling(sampling):
    """A JPEG whose scans mix code lengths, with refinement of sparse coefficients and subsampled chroma."""
    rng = np.random.default_rng(3)
    width, height = 16 * sampling[0][0], 8 * sampling[0][1]
    blocks = []
    for h, v in sampling:
        n = (width * h // sampling[0][0] // 8) * (height * v // sampling[0][1] // 8)
        c = np.where(rng.random((n, 64)) < 0.2, rng.integers(-7, 8, (n, 64)), 0)
        c[:, 0] = rng.integers(-60, 61, n)
        blocks.append(c)
    across = [width * h // sampling[0][0] // 8 for h, _ in sampling]
    # codes: all symbols of 8 bits but 0xff
    out = [media.frame_header(width, height, sampling), media.huffman_segment(0, 0, [[]] * 7 + [list(range(200))]), media.huffman_segment(1, 0, [[]] * 7 + [list(range(255))])]
    writer, last = _Writer(), [0, 0, 0]
    for y in range(height // 8 // sampling[0][1]):
        for x in range(width // 8 // sampling[0][0]):
            for i, (h, v) in enumerate(sampling):
                for dy in range(v):
                    for dx in range(h):
                        value = int(blocks[i][(y * v + dy) * across[i] + x * h + dx, 0]) >> 1
                        diff, last[i] = value - last[i], value
                        writer.put(abs(diff).bit_length(), 8)
                        if diff:
                            writer.signed(diff, abs(diff).bit_length())
    out.append(media.scan_segment([0, 1, 2], 0, 0, 0, 1, media._packed(np.array(writer.bits, np.uint8))))
    for i in range(3):
        writer = _Writer()
        for block in blocks[i]:
            run = 0
            for k in range(1, 64):
                value = int(block[k])
                value = value // 2 if value >= 0 else -(-value // 2)
                if not value:
                    run += 1
                    continue
                while run > 15:
                    writer.put(0xF0, 8)
                    run -= 16
                writer.put(run << 4 | abs(value).bit_length(), 8)
                writer.signed(value, abs(value).bit_length())
                run = 0
            if run:
                writer.put(0, 8)
        out.append(media.scan_segment([i], 1, 63, 0, 1, media._packed(np.array(writer.bits, np.uint8))))
    order = []
    for y in range(height // 8 // sampling[0][1]):
        for x in range(width // 8 // sampling[0][0]):
            order += [blocks[i][(y * v + dy) * across[i] + x * h + dx, 0] & 1 for i, (h, v) in enumerate(sampling) for dy in range(v) for dx in range(h)]
    out.append(media.scan_segment([0, 1, 2], 0, 0, 1, 0, media._packed(np.array(order, np.uint8))))
    for i in range(3):
        writer = _Writer()
        _refine(writer, blocks[i], 1, 63, 0)
        out.append(media.scan_segment([i], 1, 63, 1, 0, media._packed(np.array(writer.bits, np.uint8))))
    decoder = media.ProgressiveDecoder(b"".join(out) + b"\xff\xd9")
    for part, expected in zip(decoder.parts.values(), blocks, strict=True):
        assert (part.coefficients == expected).all()
    planes = []
    for c, a, (h, v) in zip(blocks, across, sampling, strict=True):
        natural = np.zeros((len(c), 64))
        natural[:, media.ZIGZAG] = c
        pixels = np.stack([media.DCT.T @ b.reshape(8, 8) @ media.DCT for b in natural])
        plane = pixels.reshape(-1, a, 8, 8).swapaxes(1, 2).reshape(-1, a * 8)
        planes.append(np.floor(plane + 128.5).clip(0, 255).repeat(sampling[0][1] // v, 0).repeat(sampling[0][0] // h, 1))
    red = np.floor(planes[0] + 1.402 * (planes[2] - 128) + 0.5).clip(0, 255)
    assert (decoder.rgb()[:, :, 0] == red).all()


def test_media_tables(spark):
    given_ = docs(spark, ODD)
    rows = {r["doc_id"]: r for r in media.media_digests(given_).collect()}
    for i, t in enumerate(ODD):
        payload = media.pad((t or "").encode())
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and rows[i]["payload_bytes"] == len(payload)
        assert rows[i]["n_bytes"] == len((t or "").encode()) and rows[i]["tail_crc32"] == zlib.crc32(payload[-16:])
    assert rows[5]["media_sha256"] == rows[6]["media_sha256"] and rows[5]["feature"] == rows[6]["feature"]
    stored = media.store_media(given_)
    read = {r["doc_id"]: r for r in media.read_media(stored).collect()}
    assert all(bytes(read[i]["payload"]) == media.pad((t or "").encode()) and len(read[i]["tensor"]) == read[i]["height"] * read[i]["width"] * 3 for i, t in enumerate(ODD))
    assert media.media_digests(given_.limit(0)).count() == 0


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@hypothesis_settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aab  ▁\n\t<s>é😀ﬁ\x00—theingst中文"), st.characters(codec="utf-8")), max_size=40))
def test_encoding_equals_the_library(text):
    model, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.coder(pieces.model_bytes(PATH))
    ids = model.encode(text)
    assert own.encode(text) == ids and own.decode(ids) == model.decode(ids)
    assert own.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_long_words_and_any_ids(library):
    own, rng = pieces.coder(pieces.model_bytes(PATH)), random.Random(1)
    for text in ("a" * 20_000, "".join(rng.choice("abcdefst") for _ in range(20_000)), " " * 999 + "x", "▁" * 17):
        assert own.encode(text) == library.encode(text)
    for _ in range(500):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(6)]
        assert own.decode(ids) == library.decode(ids)


def test_piece_tables(spark, library):
    given_ = docs(spark, ODD)
    encoded = pieces.encode_pieces(given_, PATH)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: library.encode(t or "") for i, t in enumerate(ODD)}
    assert {r["doc_id"]: r["text"] for r in pieces.decode_pieces(encoded, PATH).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert pieces.piece_digests(given_.limit(0), PATH).count() == 0


# ---------------------------------------------------------------- languages


def brute_kneser_ney(texts, order):
    """Interpolated Kneser-Ney by dictionaries; returns p(symbol | context)."""
    from collections import Counter

    counts = [Counter() for _ in range(order + 1)]
    streams = []
    for t in texts:
        s = languages.symbols([t]).codes.tolist()
        streams.append(s)
        for i in range(order, len(s)):  # the pads and the space in front aren't scored
            if s[i] != 0:
                counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    alphabet = len({c for s in streams for c in s}) + 1

    def probability(gram):
        k = len(gram)
        if k == 0:
            return 1 / alphabet
        ones, twos = (sum(v == n for v in counts[k].values()) for n in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = {g: v for g, v in counts[k].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        below = probability(gram[1:])
        return below if not total else max(counts[k][gram] - d, 0) / total + d * len(own) / total * below

    return probability


def test_models_equal_brute_force():
    texts = {"xx": ["abra cadabra", "bar"], "yy": ["the cat, the hat", "that"]}
    models = languages.fit(texts)
    alphabet = {c for t in texts.values() for c in languages.symbols(t).codes.tolist()}
    for lang, own in texts.items():
        truth = brute_kneser_ney(own, languages.ORDER)
        models_alone = languages.fit({lang: own})
        s = languages.symbols(["cab hat"]).codes.tolist()
        expected = -sum(np.log(truth(tuple(s[i - languages.ORDER + 1 : i + 1]))) for i in range(languages.ORDER, len(s)))
        entropies, length, _ = models_alone.cross_entropies(["cab hat"])
        assert entropies[0, 0] * length[0] == pytest.approx(expected, rel=1e-4)
    assert len(alphabet) > 5 and models.names == ["xx", "yy"]
    together = models.cross_entropies(["the hat", "abra"])[0]
    alone = [models.cross_entropies([t])[0][0] for t in ("the hat", "abra")]
    assert np.allclose(together, alone)


def test_languages_on_tables(spark):
    rng = random.Random(0)
    words = {"en": ["the", "and", "with", "that", "from"], "de": ["der", "und", "mit", "dass", "von"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=40)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 !", "de"), (1002, "", None), (1003, "жзиклм нопрст " * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = languages.learn(df, F.col("doc_id") % 3 != 1)
    found = {r["doc_id"]: r for r in languages.identify(df, models, fold=1).collect()}
    assert all(found[i]["lang_pred"] == lang and not found[i]["rejected"] and 0 <= found[i]["score"] <= 1 for i, _, lang in rows if i < 1000)
    assert all(found[i]["lang_pred"] == "und" for i in (1000, 1001, 1002)) and found[1003]["rejected"]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    kept = languages.keep_identified(df, models)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows if i < 1000}
    nothing = languages.learn(df.limit(0), F.lit(True))
    assert nothing.names == [] and {r["lang_pred"] for r in languages.identify(df, nothing).collect()} == {"und"}


def test_toxicity_risk_and_gradient():
    rng = np.random.default_rng(3)
    p, u = (rng.random((30, 7)) < 0.4).astype(float), (rng.random((50, 7)) < 0.3).astype(float)
    loss = lambda margin, sign: np.log1p(np.exp(-sign * margin)).mean()

    def brute(x, prior):
        zp, zu = p @ x[:-1] + x[-1], u @ x[:-1] + x[-1]
        return prior * loss(zp, 1), loss(zu, -1) - prior * loss(zp, -1)

    signs = set()
    for prior in (0.05, 0.3, 0.9):
        for scale in (0.2, 3.0):
            x = rng.normal(size=8) * scale
            x[-1] -= 3 * (scale > 1)
            toxic, harmless, gradient = toxicity.risk(p, u, x[:-1], x[-1], prior)
            assert np.allclose((toxic, harmless), brute(x, prior))
            signs.add(harmless >= 0)
            target = (lambda y: sum(brute(y, prior))) if harmless >= 0 else (lambda y: -brute(y, prior)[1])  # noqa: B023
            numeric = [(target(x + 1e-6 * e) - target(x - 1e-6 * e)) / 2e-6 for e in np.eye(8)]
            assert np.allclose(gradient, numeric, atol=1e-5)
    assert signs == {True, False}


def test_toxicity_learns_from_toxic_labels_alone(spark):
    rng = random.Random(8)
    words, bad = [f"plain{i}" for i in range(300)], ["vorgh", "zluk", "drabb", "mork"]
    rows = []
    for i in range(1500):
        text = rng.choices(words, k=30) + (rng.choices(bad, k=3) if i % 10 == 0 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), 1.0, "x"))
    df = spark.createDataFrame(rows + [(None, "vorgh", 1.0, "x"), (3, None, 1.0, "x"), (4, "plain " * 9000 + "mork zluk", 1.0, "x")] + [(9990, "same text", 1.0, "x")] * 50, "doc_id long, text string, score double, chosen string")
    labels = spark.createDataFrame([(i, 1, 5) for i in range(0, 1500, 10) if i % 3] + [(None, 1, 5), (20, 0, 5)], "doc_id long, toxic int, h int")
    model = toxicity.learn(df, labels, F.col("id") % 3 != 0)
    assert model.weights == toxicity.learn(df.repartition(3), labels, F.col("id") % 3 != 0).weights
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(df, model).where("doc_id < 1500 and doc_id % 3 = 0").collect()}
    assert all(scores[i] == int(i % 10 == 0) for i in scores if i not in (3, 4)) and len(scores) == 500
    nothing = toxicity.learn(df.limit(0), labels, F.lit(True))
    assert toxicity.score_toxicity(df.limit(3), nothing).agg(F.max("score")).first()[0] < 0.01 and toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_pieces_decode_broken_bytes():
    coder, library = pieces.coder(pieces.model_bytes(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for ids in ([coder.byte_ids[0xFF]] * 5000, [coder.byte_ids[b] for b in (0xE2, 0x96, 0x41, 0xF0, 0x9F, 0x98, 0x80)] * 30):
        assert coder.decode(ids) == library.decode(ids)


def test_no_language_is_lost(spark, monkeypatch):
    monkeypatch.setattr(languages, "IN_ALL", 300)
    monkeypatch.setattr(languages, "LONGEST", 400)
    rng = random.Random(4)
    words = {f"l{n:03}": ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(8)] for n in range(200)}
    rows = [(1000 * n + i, " ".join(rng.choices(words[lang], k=12)) if i % 3 else "12 - 34", lang) for n, lang in enumerate(words) for i in range(12)]
    rows += [(-i, "1234567890 " * 300 + "zzz yyy " * 400, "long") for i in range(1, 4)]
    rows += [(None, "copy copier copies", "copied")] * 700 + [(7, None, "empty"), (7, "?", "empty"), (8, "xxx qqq", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    models = languages.learn(df, F.lit(True))
    assert models.names == sorted([*words, "long", "copied"])
    again = languages.learn(df.repartition(3), F.lit(True))
    assert all((a == b).all() for a, b in zip(models.grams, again.grams, strict=True))
    found = {r["doc_id"]: r["lang_pred"] for r in languages.identify(df.where("doc_id is null or doc_id <> 7"), models).collect()}
    assert found[None] == "copied" and found[-1] == "long"
    assert sum(found[i] == (lang if t[0] != "1" else "und") for i, t, lang in rows if lang in words and i > 8) > 0.97 * 2390
    assert {r["lang_pred"] for r in languages.identify(df.where("doc_id = 7 and lang = 'empty'"), models).collect()} == {"und"}




# ---------------------------------------------------------------- toxicity


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(0)
    clean = ["tree", "house", "river", "stone", "cloud", "field"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 10 == 0
        rows.append((i, " ".join(rng.choices(clean, k=30) + (["wretch"] if toxic else [])), "ignored"))
        labels.append((i, int(toxic)))
    rows += [(900, None, ""), (901, "", ""), (902, "Wretch!", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels + labels[:5] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, marks, F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model, fold=0).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] and found[i]["predicted"] == (i % 10 == 0) for i in held)
    assert found[902]["predicted"] == 1 and found[900]["score"] == found[901]["score"] < 0.5
    assert toxicity.train([], ["a"], 0.5).score("a") < 0.5 and toxicity.train(["a"], ["b"], 0.0).score("a") < 0.5


# ---------------------------------------------------------------- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>{title}</h1><span>by A</span></header><p>{one}<br><p>two&nbsp;&amp;  <b>three</b>&lt;.<ul><li>a<li>b</ul>
<div class="tagline">Thanks for reading our site</div><aside>x</aside><form>f<input></form><section class="comments"><p>nice</p></section></article>
<footer>&copy;</footer></body></html>"""


def test_extraction():
    assert html.extract(PAGE.format(title="Big  title", one="first")) == "Big title\nfirst\ntwo & three<.\na\nb\nThanks for reading our site"
    assert html.extract("") == "" and html.extract("plain &eacute; text") == "plain é text"
    assert html.extract("<main><p>x</main><p>y") == "x" and html.extract("<p>x</p><!-- <p>z</p> --><p>y") == "x\ny"
    assert html.extract('<div class="post-header"><h1>T</h1></div><p>x<div class="post-footer">f</div><div id="header">h</div>') == "T\nx"
    assert html.extract("<article><p>unclosed <b>bold<p>next</article>") == "unclosed bold\nnext"
    assert html.extract("<div><p>a</div></div></p><td>b<" + "<div>" * 3000) .startswith("a\nb")


def test_alignment_makes_groups_optionals_and_slots():
    streams = [html.stream(html.parse(p)) for p in ("<h2>A</h2><p>x<p>y<hr><div>same</div>", "<h2>B</h2><p>z<div>same</div>")]
    wrapper = html.align(*streams)
    kinds = {x[0]: (x[1], x[2]) for x in wrapper}
    assert kinds["h2"][1] == [["#", "", None]] and kinds["p"][0] == "+" and kinds["div"][1] == [["#", "", "same"]]
    optional = html.align(html.stream(html.parse("<h2>A</h2><div>d</div>")), html.stream(html.parse("<h2>A</h2>")))
    assert [x[:2] for x in optional] == [["h2", ""], ["div", "?"]]
    pairs = html.stream(html.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert pairs == [["dl", "", [["(dt dd)", "+", [["dt", "", [["#", "", None]]], ["dd", "", [["#", "", None]]]]]]]]


def test_wrapper_drops_site_text(spark):
    rows = [(i, "http://a.example/x", PAGE.format(title=f"t{i}", one=f"text {i}")) for i in range(12)] + [(50, None, None), (51, "http://b.example/", PAGE.format(title="t", one="o"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("literals", F.lit(1))
    found = {r["page_id"]: r for r in html.extract_pages(df).collect()}
    assert all(found[i]["text"] == f"t{i}\ntext {i}\ntwo & three<.\na\nb" for i in range(12))  # without the closing line that every page has
    assert "Thanks" in found[51]["text"] and found[50]["text"] == "" and found[50]["n_chars"] == 0
    assert len(found) == 14 and html.extract_pages(df.limit(0)).count() == 0


def test_long_levels_and_long_notices_are_the_sites_own():
    notice = "All rights in these pages belong to their owner. " * 5
    rng = random.Random(4)
    kinds = ["h2", "hr", "ul", "ol", "table", "blockquote", "pre", "dl", "figure", "details"]

    def page(i):
        own = "".join(f"<div class='k{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}'><{k}>{i} {j}</{k}></div>" for j, k in enumerate(rng.choices(kinds, k=90)))
        return f'<div id="post-{i}" class="post-{1000 + i}"><p>text {i}</p>{own}<section>Closing line</section><pre>{notice}</pre></div>'

    wrapper = html.stream(html.parse(page(0)))
    for i in range(1, 30):
        wrapper = html.align(wrapper, html.stream(html.parse(page(i))))
    found, slot = html.literals(wrapper)
    text = html.extract(page(50), set(map(tuple, found)))
    assert slot and "text 50" in text and "50 89" in text and "Closing line" not in text and "rights" not in text
    assert len(wrapper[0][2]) < 3 * html.LEVEL


def test_copies_of_a_page_are_no_evidence(spark):
    """However the copies are dealt over partitions."""
    copy = "<article><h1>Big</h1><p>The lead line.</p><div>A short quotation.</div><ul><li>a<li>b</ul></article>"
    rows = [(i, "http://c.example/", copy) for i in range(40)] + [(100 + i, "http://c.example/", copy + f"<script>{i}</script>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 16):
        assert {r["text"] for r in html.extract_pages(df.repartition(parts)).collect()} == {"Big\nThe lead line.\nA short quotation.\na\nb"}


def raw_stream(node):
    """What an element holds, not folded: (kind, text or children)."""
    items = []
    for child in node.children:
        if isinstance(child, str):
            inner = [("#", html._literal(" ".join(child.split())))] if child.strip() else []
        elif child.noise or child.tag in html.VOID:
            continue
        elif child.tag in html.BLOCK:
            items.append((child.kind, raw_stream(child)))
            continue
        else:
            inner = raw_stream(child)
            inner = inner[:1] if len(inner) == 1 and inner[0][0] == "#" else [("#", None)] if inner else []
        if inner and items and items[-1][0] == "#":
            items[-1] = ("#", None)
        else:
            items += inner
    return items


def matches(wrapper, items):
    """Whether the union-free expression gives these items (sets of places reached, item by item)."""

    def one(item, starts):
        kind, _, inner = item
        if kind == "(...)":
            return set(range(min(starts), len(items) + 1)) if starts else set()
        if kind.startswith("("):
            return run(inner, starts)
        fits = lambda x: x[0] == kind and ((inner is None or inner == x[1]) if kind == "#" else matches(inner, x[1]))
        return {s + 1 for s in starts if s < len(items) and fits(items[s])}

    def run(sequence, starts):
        for item in sequence:
            low, high = html._OFTEN[item[1]]
            reached, now = (set(starts) if low == 0 else set()), starts
            while now:
                now = one(item, now) - reached
                reached |= now
                if high == 1:
                    break
            starts = reached
        return starts

    return len(items) in run(wrapper, {0})


def site_pages(n, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = [f"<p>{' '.join(rng.choices(['alpha', 'beta', 'gamma', 'delta'], k=6))} {i}</p>" for _ in range(rng.randrange(1, 5))]
        extra = [f"<blockquote>quote {i}</blockquote>", f"<ul>{''.join(f'<li>{i} {j}' for j in range(rng.randrange(1, 4)))}</ul>", "<figure><figcaption>view</figcaption></figure>", "<p>As seen elsewhere</p>"]
        parts += [e for e in extra if rng.random() < 0.5]
        rng.shuffle(parts)
        out.append(f"<html><body><h1>Title {i}</h1><div class='lead'>Read this site daily</div><div class='text'>{''.join(parts)}</div><section><div>Printed with care</div></section></body></html>")
    return out


def test_wrappers_match_every_page_they_come_from():
    pages = [html.parse(p) for p in site_pages(40)]
    wrapper = html.stream(pages[0])
    for page in pages[1:]:
        wrapper = html.align(wrapper, html.stream(page))
    assert all(matches(wrapper, raw_stream(p)) for p in pages)
    assert not matches(wrapper, raw_stream(html.parse("<h1>t</h1><div class='lead'>Something else</div>")))
    found, slot = html.literals(wrapper)
    assert slot and {t for _, t in found} >= {"Read this site daily", "Printed with care"}


def test_results_do_not_hang_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(html, "BRANCH", 4)  # several levels
    pages = site_pages(150)
    rows = [(i, f"http://{'hot' if i % 10 else f'h{i % 3}'}.example/{i}", p, "a", 1) for i, p in enumerate(pages)] + [(None, "http://hot.example/", pages[1], "a", 1), (1, "http://hot.example/", None, "a", 1)]
    rows.append((7000, "http://hot.example/deep", "<div>" * 600 + "deep inside" + "</div>" * 600, "a", 1))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, mark int")
    results = [sorted(map(str, html.extract_pages(df.repartition(n) if n > 1 else df.coalesce(1)).collect())) for n in (1, 3, 16)]
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)
    texts = {r["page_id"]: r["text"] for r in html.extract_pages(df).where("page_id > 1").collect()}
    plain = {i: html.extract(p) for i, p in enumerate(pages)}
    assert texts[7000] == "deep inside"
    for i in range(2, 150):  # generated: title, then the article's own lines
        own = [line for line in plain[i].split("\n") if line not in ("Read this site daily", "Printed with care")]
        assert texts[i].split("\n") in (own, plain[i].split("\n"))


def test_short_articles_stay():
    long = "word " * 200
    assert html.extract(f"<article><p>{long}</article><article><p>short news</article><article class='ad'>buy</article>") == f"{long.strip()}\nshort news"
