import hashlib
import math
import os
import re

import numpy as np
import pytest
from corpus import AWKWARD, CLASH, awkward, none
from pyspark.sql import functions as F

from tallybook.llm import htmltext, licenses, warc
from tallybook.session import fresh_path

NOTICE = "This is free software. Released under the MIT License. All Rights Reserved, CC-BY and cc by cc by."
MIT = ("Permission is hereby granted, free of charge, to any person getting a copy of this software and "
       "associated documentation files")


def plain(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({label for _, label in places})))


def test_license_scan(spark):
    extra = [(30, NOTICE), (31, MIT), (32, "cc BY"), (33, "general public licenſe, general\npublic license"),
             (34, "the Kc by İ"), (35, "x " * 30_000 + "all rights reserved"), (32, "cc BY"), (36, "licensed under the")]
    docs = awkward(spark).select("doc_id", "text", *CLASH).unionByName(
        spark.createDataFrame(extra, "doc_id long, text string").select("doc_id", "text", *[F.lit("").alias(c) for c in CLASH]))
    got = licenses.scan(docs).collect()
    rows = [r[:2] for r in AWKWARD] + extra
    want = sorted(((k, *plain(t)) for k, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[30].labels == "cc-by,mit,reserved" and by_id[30].score == 1
    # one replaced word: the runs around it fail, the rest still votes on one diagonal
    assert by_id[31].labels == "mit" and 0.8 <= by_id[31].score < 1
    assert (by_id[36].labels, by_id[36].score) == ("", 0.0)
    assert licenses.scan(none(spark)).count() == 0


def test_inserted_words_merge_neighbouring_diagonals(spark):
    words = MIT.replace("getting", "obtaining").split()
    text = " ".join(words[:9] + ["wholly"] + words[9:])
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.labels == "mit"
    far = " ".join(words[:9] + ["and"] * 40 + words[9:])
    assert licenses.scan(spark.createDataFrame([(1, far)], "doc_id long, text string")).first().labels == ""


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<nav>menu</nav>", ""),
    ("<html><head><title>T</title></head><body><article><h1>A &eacute;</h1><p>one\n two<br>three</p></article></body>",
     "A é\n\none two three"),
    ("<article><p>a<p>b<script>var x='<p>no</p>';</script><aside>no</aside><form><p>no</form></article><p>out", "a\n\nb"),
    ("<body><header>Site name</header><div class='post'><p>A paragraph that is long enough to be content."
     "<p>Next <em>one</em>!</div><div id='comments'><p>I think that this is a wonderful text indeed</div>"
     "<footer>(c)</footer>", "A paragraph that is long enough to be content.\n\nNext one!"),
    ("<main><header><h1>Title</h1></header><section><h2>Part</h2><p>x</section><section class=ad><p>buy</section></main>",
     "Title\n\nPart\n\nx"),
    ("<article><p>cut off in the mid", "cut off in the mid"), ("<p>a &lt;b&gt; &#233; &nbsp; c", "a <b> é c"),
])
def test_main_text(page, want):
    assert htmltext.main_text(page) == want


STORY = "<p>A first paragraph that is long enough to be content.<p>And a second one that is just as long as it."
TOLD = "A first paragraph that is long enough to be content.\n\nAnd a second one that is just as long as it."
WIDGET = "<div class='elementor-widget elementor-widget-text-editor'><div class='elementor-widget-container'>"


@pytest.mark.parametrize("page, want", [
    (f"<body class='has-sidebar'><article class='post has-sidebar comments-open'>{STORY}</article>", TOLD),
    (f"<article class='sidebar' id='related'>{STORY}<div class='widget'><p>no</div></article>", TOLD),
    (f"<body><div class='site has-sidebar comments-open'>{STORY}</div>", TOLD),
    (f"<article>{''.join(f'{WIDGET}{p}</div></div>' for p in STORY.split('<p>'))}</article>", TOLD),
    (f"<body><div class='content-sidebar-wrap'><div class='post'>{STORY}</div>"
     "<div class='sidebar-left'><p>no</div><div class='widget widget_recent'><p>no</div></div>", TOLD),
    (f"<article>{STORY}<div class='ad-slot-2'><p>no</div><div class='social-links'><p>no</div></article>", TOLD),
    (f"<body><div class='post'>{STORY}</div><div id='comments' class='comments-area'>{STORY * 3}</div>", TOLD),
    (f"<article>{STORY} <span class='share'>no</span></article>", TOLD),
    (f"<article>{STORY}<div role='navigation'><p>no</div><div hidden>no</div></article>", TOLD),
])
def test_classes_of_ordinary_themes(page, want):
    assert htmltext.main_text(page) == want


TEASER = "<article>" + "".join(f"<p><a href='/{k}'><b>more</b></a> <i>{k}</i></p>" for k in "abcdef") + "</article>"


@pytest.mark.parametrize("page, want", [
    (f"<article>{STORY}</article>{TEASER}", TOLD),
    (f"{TEASER}<main><h1>Head</h1><article>{STORY}</article>{TEASER}</main>", "Head\n\n" + TOLD),
    (f"<div>{STORY.replace('A first', 'Some other')}</div><article>{STORY}</article>", TOLD),
    (f"<article>{STORY}<section><p>ok</p></section></article>{TEASER}", TOLD + "\n\nok"),
])
def test_the_ratio_chooses_among_articles(page, want, monkeypatch):
    assert htmltext.main_text(page) == want
    monkeypatch.setattr(htmltext, "smoothed", lambda ratio: np.full(len(ratio), 9.0))
    assert (htmltext.main_text(page) == want) == (TEASER not in page)


def test_smoothing_equals_brute_force():
    ratio = np.random.default_rng(1).exponential(50, 40)
    want = []
    for i in range(40):
        near = [(math.exp(-(i - j) ** 2 / (2 * htmltext.SIGMA**2)), r) for j, r in enumerate(ratio)
                if abs(i - j) <= math.ceil(3 * htmltext.SIGMA)]
        want.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    assert np.allclose(htmltext.smoothed(ratio), want)


def test_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>para {i}</p>" for i in range(120_000)) + "</article>"
    assert htmltext.main_text(page) == "\n\n".join(f"para {i}" for i in range(120_000))


def pages(spark):
    big = "<p>" + "é" * 200
    rows = [(3, "u3", big), (1, None, big), (2, "http://x/ü\r\nX: y", "short"), (5, "u5", "short"), (4, "u", None),
            (None, "n", big), (1, None, big), (6, "u6", ""), (7, "u7", "x" * 700_000), (8, "u8", big + "!")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")), rows


def test_extract(spark):
    df, rows = pages(spark)
    got = {(r.page_id, r.url): r for r in htmltext.extract(df).collect()}
    assert got[4, "u"].text == "" and got[3, "u3"].n_chars == 200 and len(htmltext.extract(df).collect()) == len(rows)
    assert htmltext.extract(df.where("false")).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 500)
    df, rows = pages(spark)
    folder = fresh_path(spark, "warc")
    manifest = warc.write(df, folder)
    got = warc.read(manifest).collect()
    assert len(got) == len(rows)
    want = []
    for key, url, html in rows:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and data == rows[0][2].encode() and key != 1
        want.append((key, url, len(data), digest, "revisit" if again else "response", 1 if again else None))
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got),
                  key=repr) == sorted(want, key=repr)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    bundles = {r.bundle for r in manifest.collect()}
    frames = manifest.select("bundle", "frame_offset", "frame_bytes", "plain_bytes").distinct().collect()
    listed = {(b, *f) for b in bundles for f in warc.seek_table(b)}
    assert listed == {tuple(f) for f in frames}
    import zstandard
    data = open(next(iter(bundles)).removeprefix("file://"), "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n")
    assert os.path.isdir(folder.removeprefix("file://"))
    assert warc.read(warc.write(df.where("false"))).count() == 0


def test_reading_tasks_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 2000)
    monkeypatch.setattr(warc, "READ_BYTES", 10_000)
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.repeat(
        F.concat(F.lit("text "), F.col("id").cast("string")), 300).alias("html"))
    back = warc.read(warc.write(pages))
    assert back.rdd.getNumPartitions() >= 8
    assert sorted(r.page_id for r in back.collect()) == list(range(60))
