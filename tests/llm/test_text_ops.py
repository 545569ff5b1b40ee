"""Per-document operators: against plain Python, other libraries, exact round trips and held-out accuracy."""

import base64
import hashlib
import pathlib
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import bpe, decontam, html_main, langid, license, quality, queries, toxicity
from helixframe.llm.textscan import Scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "é ü\n\nß", "\x1c x y", "a b c d e " * 3, "l1\nl1\nl2\n \nl1", "#*$%&|<>", "x" * 3000, "w " * 2000]
DATA = "/root/testdata/sf0.01"


def odd_docs(spark, rows=ODD):
    docs = spark.createDataFrame([(i, t, None, "s", 7.5) for i, t in enumerate([*rows, rows[3]])], "doc_id long, text string, lang string, score string, kept double")
    return docs.unionByName(docs.limit(1))


def base(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    rep = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 400 else set(range(len(words)))
    failed = len(words) < 10 or 100 * len(rep) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(rep), failed)


def test_quality_counts(spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    rows = quality.quality_rules(odd_docs(spark), labels).collect()
    texts = [*ODD, ODD[3]]
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert tuple(r)[1:7] == base(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(odd_docs(spark).limit(0), labels.limit(0)).count() == 0


def test_quality_learns(spark):
    d = queries.table(spark, DATA, "documents")
    labels = queries.table(spark, DATA, "labels")
    got = quality.quality_rules(d, labels).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) > 0.85 * len(got)


def test_license_scan(spark):
    docs = spark.createDataFrame([(1, "Copyright 2020 X\nlicenced under the APACHE licence -- version 2.0"), (2, "foo\nReleased under the MIT License.\nReleased under the MIT licence"), (3, None), (4, "")], "doc_id long, text string")
    rows = {(r.doc_id, r.scope, r.license_id): r.n_matches for r in license.license_scan(docs).collect()}
    assert rows == {(1, "text", "Apache-2.0"): 1, (1, "line", "Apache-2.0"): 1, (2, "line", "MIT"): 2}


def test_license_texts_in_their_usual_wrapping(spark):
    wrapped = lambda t, n: re.sub(rf"(.{{1,{n}}})( |$)", r"\1\n", t)
    texts = dict(license.KNOWN)
    rows = [(1, "MIT License\n\nCopyright (c) 2024 A Person\n\n" + wrapped(texts["MIT"].replace("\n", "\n\n"), 76)), (2, "Copyright 2001, 2004 Someone\n" + wrapped(texts["ISC"].replace("\n", " "), 72))]
    rows += [(3, "BSD 3-Clause License\n\nCopyright (c) 2019, X\nAll rights reserved.\n\n" + license.BSD.format(n1="1. ", n2="2. ", third="3. " + license.BSD_THIRD + "\n\n")), (4, "Copyright notice and this and that"), (5, texts["Zlib"])]
    rows += [(5, texts["Zlib"]), (6, "word " * 100_000 + "\nReleased under the MIT License."), (7, "MIT License")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license_id string")
    got = {(r.doc_id, r.scope, r.license_id): r.n_matches for r in license.license_scan(docs).collect()}
    assert got == {(1, "text", "MIT"): 1, (2, "text", "ISC"): 1, (3, "text", "BSD-3-Clause"): 1, (5, "text", "Zlib"): 2, (6, "line", "MIT"): 1}
    assert license.license_scan(docs.limit(0)).count() == 0
    own = license.license_scan(docs.select(F.lit(1).alias("doc_id"), F.lit("GPL version 9").alias("text")), [("GPL-9", "GNU General Public License version 9")])
    assert {r.license_id for r in own.collect()} == {"GPL-9"}


MIT = next(t for i, t in license.KNOWN if i == "MIT" and len(t) > 500)


@pytest.mark.parametrize("line", ["Copyright Acme Corporation and contributors", "Copyright Jane Doe <jane@example.org>", "copyright The Example Project", "Copyright 2001 Jane", "(c) 2001 Jane", "Copyright by Jane Doe\nCopyright John Doe"])
def test_license_copyright_lines(spark, line):
    wrapped = MIT.replace("The above copyright", "The above\ncopyright").replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS")
    texts = [(1, f"MIT License\n\n{line}\n\n{MIT}"), (2, f"{line}\n{wrapped}"), (3, wrapped), (4, f"{line}\nOther words.\n{MIT[:400]}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r.doc_id, r.license_id) for r in license.license_scan(docs).collect() if r.scope == "text"} == {(k, "MIT") for k in (1, 2, 3)}


COMMON = pathlib.Path("/usr/share/common-licenses")
FILES = {"Artistic-1.0-Perl": "Artistic", "BSD-3-Clause": "BSD"} | {f"{x}.0": x for x in ("GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-3")}


@pytest.mark.skipif(not COMMON.is_dir(), reason="the public texts are not on this machine")
def test_license_long_texts(spark):
    """Every digest is that of the public text, however its lines are broken; DuckDB finds the same."""
    rows = []
    for k, (name, _, _) in enumerate(license.DIGESTS):
        text = (COMMON / FILES.get(name, name)).read_text()
        shout = re.sub(r"[ \t]+", "  ", text.replace("https://", "http://")).replace(";", " ;")
        fill = lambda p: textwrap.fill(p, 44, break_long_words=False, break_on_hyphens=False)
        body = "\n\n".join(p if "(c)" in p.lower() or max(len(x.strip()) for x in p.split("\n")) < 60 else fill(p) for p in text.split("\n\n"))
        rows += [(10 * k, text), (10 * k + 1, shout), (10 * k + 2, body), (10 * k + 3, " ".join(text.rsplit(" of ", 1)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.scope, r.license_id, r.n_matches) for r in license.license_scan(docs).collect()}
    assert {(d, name) for d, scope, name, _ in got if scope == "text"} == {(10 * k + j, name) for k, (name, _, _) in enumerate(license.DIGESTS) for j in range(3)}
    con = duckdb.connect()
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    con.register("documents", documents)
    assert set(con.execute(license.oracle_sql()).fetchall()) == got


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">Accept</div><article><h1>Head&amp;line</h1><p>One
 two&nbsp;three <b>bold</b><p>Second</p><div class="ad-box">Buy</div><ul><li>x<li>y</ul></article><section id="comments"><p>Nice post, long reader comment here</p></section>
<aside>Side</aside><form>Name <input></form><footer>Foot</footer>"""


def test_html(spark):
    assert html_main.extract(PAGE) == "Head&line\nOne two three bold\nSecond\nx\ny"
    assert html_main.extract(None) == html_main.extract("") == html_main.extract("<nav>x</nav>") == ""
    plain = "<body><div class=menu>a</div><h2>Title</h2><p>" + "long text " * 30 + "</p><p>" + "more text " * 30 + "</p><div class=footer>f</div>"
    assert html_main.extract(plain).split("\n")[0] == "Title" and len(html_main.extract(plain).split("\n")) == 3
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in html_main.main_text(pages).collect()} == {1: len(html_main.extract(PAGE)), 2: 0}


def test_html_drops_nothing_else():
    long = "<p>" + "long text " * 40 + "</p>"
    page = f"<body><div class=menu>a</div><p>Short start.</p>{long * 4}<p>The end.</p><div class=footer>f</div>"
    lines = html_main.extract(page).split("\n")
    assert lines[0] == "Short start." and lines[-1] == "The end." and len(lines) == 6
    for wrapper in ("content no-sidebar", "has-header", "with-comments"):
        assert len(html_main.extract(f"<div class='{wrapper}'>{long * 2}</div>").split("\n")) == 2
    assert all(html_main.marked([("class", c)]) for c in ("ad", "ad1", "box ad-box", "cookie-notice", "site-header", "footer-links", "post-comments"))


LONG = "A sentence of the article with plenty of words, so that it is rich in text, as it goes on and on. " * 4


@pytest.mark.parametrize(
    ("page", "n_lines"),
    [
        (f"<html><head><title>T</title><body><p>{LONG}</p></body></html>", 1),
        (f"<html><head><meta charset=x>{LONG}", 1),
        (f"<p class='ad'>Buy<div>{LONG}</div>", 1),
        (f"<div class=menu><ul><li><a href=x>Home</a></li><li><a href=y>Shop</a></li></ul><p>{LONG}</p><p>Short.</p><p>{LONG}</p>", 3),
        (f"<div class='share-price-report'><p>{LONG}</p></div>", 1),
        (f"<div class='social-policy-article'><p>{LONG}</p><div class='comments'>{LONG}</div></div>", 1),
        (f"<div class='tags-explained'><p>{LONG}</p></div>", 1),
        (f"<div role='main' class='login'><p>{LONG}</p></div>", 1),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><article><h3><a href=x>Other</a></h3><p>A teaser.</p></article>", 2),
        (f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>", 2),
        (f"<ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul><h1>Head</h1><p>{LONG}</p><p><a href=z>One link</a></p><p>{LONG}</p>", 4),
        (f"<form id=page><h1>Head</h1><p>{LONG}</p><form>x</form></form>", 2),
        (f"<p>{LONG}</p><form><label>Name</label><input></form>", 1),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><div class=comments><p>{LONG}", 2),
        (f"<p>{LONG}</p><div class='share-buttons'><a href=x>One</a> <a href=y>Two</a></div>", 1),
    ],
)
def test_html_marks_and_open_elements(page, n_lines):
    lines = html_main.extract(page).split("\n")
    assert len(lines) == n_lines and LONG.strip() in lines
    assert not {"Buy", "Home", "Shop", "About", "Name", "A teaser.", "One Two", "T"} & set(lines)


def held_out(text, m):
    return zlib.crc32(str(text).encode()) % m


def found_and_false(rows):
    hits = sum(r.predicted and r.toxic for r in rows)
    return hits / max(1, sum(r.toxic for r in rows)), hits / max(1, sum(r.predicted for r in rows))


def test_toxicity(spark):
    """Held out, at sf0.1: far more than a constant answer finds, and than one word of the label's odds does."""
    d, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.train(d, labels)
    got = toxicity.score(d, model).join(labels, "doc_id").where("held_out").collect()
    assert all(held_out(r.doc_id, 5) == 0 for r in got)
    recall, precision = found_and_false(got)
    assert recall >= 0.8 and precision >= 0.9
    words = lambda t: set(re.findall(r"[^\W\d_]+", t.lower()))
    rows = d.join(labels, "doc_id").select("doc_id", "text", "toxic").where("text is not null").collect()
    seen, bad = Counter(), Counter()
    for r in rows:
        if held_out(r.doc_id, 5):
            seen.update(words(r.text))
            bad.update(words(r.text) if r.toxic else ())
    listed = {w for w in bad if bad[w] >= 5 and bad[w] >= 0.9 * seen[w]}
    theirs = [r for r in rows if not held_out(r.doc_id, 5)]
    odds = sum(bool(words(r.text) & listed) for r in theirs if r.toxic) / sum(r.toxic for r in theirs)
    print("recall", recall, "precision", precision, "recall of a word list", odds)
    assert recall > odds - 0.1
    odd = toxicity.score(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.drop_toxic(odd_docs(spark), model).columns == odd_docs(spark).columns
    assert toxicity.toxicity(d.limit(5), labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.toxicity(d.limit(0), labels).count() == 0


def test_toxicity_windows():
    """The windows' logits, against the network run plainly over one stretch and each window pooled by itself."""
    model = toxicity.ToxicityModel()
    texts = ["one", "b c d", " ".join(f"w{k % 7}x" for k in range(40)), "", " ".join(chr(97 + k % 26) * (1 + k % 5) for k in range(200))]
    words, index, ptr = toxicity.read(texts)
    x = model.inputs(words)
    start, z = model.windows(model.projected(x), index, ptr)
    p = model.p
    for d, n in enumerate(np.diff(ptr)):
        own = slice(*np.searchsorted(start, ptr[d : d + 2]))
        assert len(z[own]) == (max(1, n - toxicity.WINDOW + 1) if n else 0)
        if 0 < n <= toxicity.CHUNK:
            h = x[index[ptr[d] : ptr[d + 1]]][:, None, :]
            mask = np.ones((n, 1), dtype=bool)
            hs = np.concatenate([toxicity.run_gru(h @ p["wf"] + p["bf"], mask, p["uf"]), toxicity.run_gru(h[::-1] @ p["wb"] + p["bb"], mask, p["ub"])[::-1]], axis=2)[:, 0]
            e, y = np.exp(np.tanh(hs @ p["att"]) @ p["v"]), hs @ p["out"]
            for k, got in enumerate(z[own]):
                w = slice(k, k + toxicity.WINDOW)
                assert abs((e[w] * y[w]).sum() / e[w].sum() + p["o"][0] - got) < 1e-3


def test_language(spark):
    d = queries.table(spark, DATA, "documents")
    got = langid.language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(held_out(r.doc_id, 3) == 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    rows = langid.language_id(odd_docs(spark)).collect()
    assert {r.lang_pred for r in rows} == {"und"}
    model = langid.fit([("hello there", "en"), ("bonjour la", "fr")] * 5)
    assert model.predict(["123 !", None, "bonjour"])[0] == ["und", "und", "fr"]


@pytest.fixture(scope="module")
def codec():
    tok = pytest.importorskip("public_tokenizers")
    return bpe.codec(tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)


def test_bpe_matches_the_library(spark, codec):
    tiktoken, tok = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tok.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(3)
    letters = " \n\t\x1c ab'srEé1²Ⅷ中😀_.!　"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(draw.choice("ab") for _ in range(draw.randint(0, 90))) for _ in range(500)] + ["abaa" * 2000, "<|endoftext|> x"]
    for text, (n, ids, raw) in zip(texts, codec.summaries(texts), strict=True):
        want = theirs.encode_ordinary(text)
        assert (n, ids, raw) == (len(want), " ".join(map(str, want)), text.encode())
        assert codec.encode(text) == want
    docs = spark.createDataFrame([(1, "hello  world"), (2, None)], "doc_id long, text string")
    back = bpe.bpe_decode(bpe.bpe_encode(docs, tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)
    assert {r.doc_id: bytes(r.data) for r in back.collect()} == {1: b"hello  world", 2: b""}
    row = bpe.bpe_round_trip(docs, tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN).where("doc_id = 2").first()
    assert row.n_tokens == 0 and row.ids_sha256 == row.decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_bpe_encodes_new_pieces_of_a_batch_once(monkeypatch):
    tok = pytest.importorskip("public_tokenizers")
    own = bpe.Codec(tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN, cache_size=40)
    calls = []
    encode_many = own.encode_many
    monkeypatch.setattr(own, "encode_many", lambda pieces: calls.append(len(pieces)) or encode_many(pieces))
    texts = ["", " lone", "zorblat quux zorblat quux", "a\u2003 b c\xa0 d é f\x85 g “h” i　 j", "tail  \n", "x \0 y", "中 文 字 ß Ω", "quux " * 30, "tail"]
    columns = [pa.array(texts, pa.string()), pa.array([None, *texts[::-1]], pa.string())]
    for _ in range(2):
        for column, got in zip(columns, own.buffers(columns), strict=True):
            for text, (n, ids, raw) in zip(column.to_pylist(), got, strict=True):
                want = own.encode(text or "")
                assert (n, bytes(ids).decode(), bytes(raw)) == (len(want), " ".join(map(str, want)), (text or "").encode())
    assert len(calls) == 1  # both columns' pieces together, and none again
    many = [pa.array([f"piece{i} of{i}" for i in range(100)])]
    assert [[bytes(x[1]) for x in c] for c in own.buffers(many)] == [[" ".join(map(str, own.encode(t))).encode() for t in many[0].to_pylist()]]
    assert len(own.known) == len(own.first) == len(own.size) == 40
    assert [x[0] for c in own.buffers(columns) for x in c] == [len(own.encode(t or "")) for c in columns for t in c.to_pylist()]


def test_bpe_gathers_bounded_runs(monkeypatch, codec):
    assert list(bpe.spans(np.array([0, 3, 3, 10, 12, 12]), 4)) == [(0, 2), (2, 3), (3, 5)]
    sizes = []
    ids_of = codec.ids_of
    monkeypatch.setattr(codec, "ids_of", lambda rows, ptr: sizes.append(len(rows)) or ids_of(rows, ptr))
    texts = pa.array(["a b c d e" * 100] * 1200)
    assert len({(n, bytes(ids)) for own in codec.buffers([texts]) for n, ids, _ in own}) == 1
    assert len(sizes) > 1 and max(sizes) <= bpe.PIECES < sum(sizes)


QUESTION = "A train leaves Paris at 30 km per hour and Alice waits 12 minutes for the second train to arrive in the station at noon."


def test_decontamination(spark):
    bench = spark.createDataFrame([(7, QUESTION), (8, None), (9, "too short")], "item_id long, text string")
    other = QUESTION.replace("Paris", "London").replace("30", "45").replace("Alice", "Bobby").replace("12", "7")
    mixed = "At noon Paris is 30 km from Paris. " + QUESTION
    docs = spark.createDataFrame([(1, "x y z. " + QUESTION + " And more."), (2, other), (3, QUESTION[:40]), (4, None), (5, mixed)], "doc_id long, text string")
    rows = {(r.doc_id, r.item_id, r.verbatim) for r in decontam.leaks(docs, bench).collect()}
    assert rows == {(1, 7, True), (2, 7, False), (5, 7, True)}
    assert {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()} == {3, 4}
    assert decontam.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_wants_consistent_slots():
    text = "When 5 apples and 5 pears cost 7 coins then 5 plums and 7 figs cost how much in the market today please"
    index = decontam.Index([1], [text])
    assert index.matches(pa.array([text.replace("5", "8").replace("7", "3")]))
    assert not index.matches(pa.array([text.replace("5", "8", 1)]))


def test_decontamination_at_sentence_starts():
    names = "Tom has 3 apples. Tom gives 2 to Ann. How many are left now?"
    assert decontam.Index([1], [names]).matches(pa.array([names.replace("Tom", "Bob").replace("3", "5").replace("2", "1")]))
    found = lambda item, text: [m[4] for m in decontam.Index([1], [item]).matches(pa.array([text]))]
    item = "Water boils at a lower temperature on high mountains"
    assert found(item, f"and as we know, {item} because of pressure") == [True]
    assert found(item, f"and as we know {item.lower()} because of pressure") == [True]
    heavy = "Add 1 2 3 4 5 6 7 to 8 9 10 11 12 13"
    assert found(heavy, f"so {heavy} and stop") == [True]
    assert not found(heavy, "so add 1 2 3 4 6 5 7 to 9 8 10 11 13 12 and stop")


def test_decontamination_survives_a_clash():
    near = "The farmer has 3 apples and 5 pears in the old basket near the wooden gate of the garden today"
    assert decontam.Index([1], [near]).matches(pa.array([near.replace("5", "3")]))  # two values become equal
    rest = "and the baker counts all loaves of bread that lie on the long table by the door before the guests come in to eat"
    twice = f"Take 5 apples and 5 pears then walk home slowly with the basket {rest}"
    for text in (twice, f"{twice} then 5 more cakes"):
        index = decontam.Index([1], [text])
        assert index.matches(pa.array([text.replace("5", "8", 1)]))
    names = "Then we saw 5 men come over 5 hills to find 5 stones under 5 trees where 5 birds sing for 5 hours about 5 kings who own 5 crowns and wear 5 coats in the town"
    assert decontam.Index([1], [names]).matches(pa.array([names.replace("5", "8", 1)]))  # a long verbatim stretch


def test_scan_agrees_with_a_pattern():
    texts = [t for t in ODD] + [" a\x85b"]
    scan = Scan(pa.array(texts, pa.string()))
    for d, t in enumerate(texts):
        assert scan.ptr[d + 1] - scan.ptr[d] == len(WORD.findall(t or ""))
