"""Operators over the whole corpus and the pipeline: against brute force on small inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter

import corpus_pipeline
from helixframe.llm import linededup, neardup, substring
from helixframe.llm.shared import components

WORDS = [f"{a}{b}" for a in ("ba", "ko", "lu", "mi", "tes", "ron", "vas", "qui") for b in ("na", "ra", "st", "en", "ol", "um", "ix", "ag")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, cls string")


def text(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def edited(draw, t, k):
    w = t.split(" ")
    for _ in range(k):
        w[draw.randrange(len(w))] = draw.choice(WORDS)
    return " ".join(w)


def union(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = union({x for p in pairs for x in p}, pairs)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def near_fixture():
    draw = random.Random(5)
    rows, n = [], 0
    for _ in range(12):
        t = text(draw, draw.randint(60, 160))
        for k in (0, 0, 1, 2, 4):
            rows.append((n, edited(draw, t, k)))
            n += 1
    hub = text(draw, 120)
    rows += [(n + k, edited(draw, hub, 2)) for k in range(40)] + [(n + 40, hub)]
    rows += [(900, None), (901, None), (902, ""), (903, ""), (904, "one two three"), (905, "one two three"), (906, "One two three")]
    return rows


def test_near_duplicates(spark):
    rows = near_fixture()
    grams = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        grams[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    docs = frame(spark, rows)
    idf = neardup.document_frequencies(docs)
    assert idf.weight.min() >= neardup.LOWEST - 1e-6 and idf.weight.max() <= 1
    weight = lambda s: share_weight(grams, s, len(rows))
    pairs = []
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a is not None and a == b:
            pairs.append((i, j))
        elif (grams[i] & grams[j]).total():
            both, either = grams[i] & grams[j], grams[i] | grams[j]
            if sum(n * weight(s) for s, n in both.items()) >= 0.8 * sum(n * weight(s) for s, n in either.items()):
                pairs.append((i, j))
    want = union([i for i, _ in rows], pairs)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == want
    kept = neardup.drop_near_duplicates(docs.unionByName(docs.limit(3)))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def share_weight(grams, s, n, cache={}):  # noqa: B006
    import math

    key = (id(grams), s)
    if key not in cache:
        share = sum(s in g for g in grams.values()) / n
        cache[key] = 1 - (1 - neardup.LOWEST) * math.log(share / neardup.SHARE) / math.log(1 / neardup.SHARE) if share > neardup.SHARE else 1.0
    return cache[key]


def test_line_dedup(spark):
    draw = random.Random(8)
    lines = [text(draw, 200) for _ in range(6)]
    hub = [edited(draw, lines[0], 1) for _ in range(30)]
    rows = [(1, f"{lines[0]}\nshort\n\n{lines[1]}"), (2, f"SHORT!\n{lines[1].upper()}.\nown {lines[2]}"), (3, None), (4, ""), (5, "???\n???"), (6, lines[1] + " 12")]
    rows += [(10 + k, h) for k, h in enumerate(hub)]
    out = {r.doc_id: (r.text, r._n_lines, r._n_removed) for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert out[1] == (rows[0][1], 4, 0)
    assert out[2] == (f"own {lines[2]}", 3, 2)
    assert out[3] == (None, 0, 0) and out[4] == ("", 1, 0) and out[5] == ("???\n???", 2, 0) and out[6] == ("", 1, 1)
    assert sum(out[10 + k][2] for k in range(30)) >= 27  # copies of one line with one word changed
    assert linededup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_keeps_lines_that_differ_in_numbers(spark):
    rows = [(1, "Total: 12\nx = 5"), (2, "Total: 874"), (3, "x = 93817"), (4, "TOTAL:  12"), (5, "total, 12")]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert out == {**dict(rows), 4: "", 5: ""}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_pairs():
    """Pairs of a line and its edited copy, of 4 to 30 words, with an edit similarity of 0.8 or more: (kind, line, copy)."""
    draw, out = random.Random(11), []
    for n in (4, 6, 8, 10, 15, 20, 30):
        for kind in ("word", "typo", "words", "typos"):
            for _ in range(12):
                a = " ".join("".join(draw.choice("abcdefghiklmnoprstuvw") for _ in range(draw.randint(2, 9))) for _ in range(n))
                k = 1 if kind in ("word", "typo") else max(2, n // 8)
                if kind.startswith("word"):
                    b = edited(draw, a, k)
                else:
                    b = list(a)
                    for at in draw.sample(range(len(b)), k):
                        b[at] = draw.choice("xyz")
                    b = "".join(b)
                if a != b and 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8:
                    out.append((kind, a, b))
    return out


def test_line_dedup_recall(spark):
    pairs = line_pairs()
    rows = [(k, f"{a}\n{b}") for k, (_, a, b) in enumerate(pairs)]
    gone = {r.doc_id: r._n_removed for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    share = {kind: sum(gone[k] for k, p in enumerate(pairs) if p[0] == kind) / sum(p[0] == kind for p in pairs) for kind in ("word", "typo", "words", "typos")}
    print(len(pairs), share)
    assert share["word"] == share["typo"] == 1 and share["words"] >= 0.9 and share["typos"] >= 0.9


def hard_pairs():
    """Lines and copies with an edit similarity of 0.8 or more that few equal words or no spaces connect: (kind, line, copy)."""
    draw, out = random.Random(5), []
    word = lambda n: "".join(draw.choice("abcdefghiklmnoprstuvw") for _ in range(n))

    def typos(t, n):
        t = list(t)
        for at in draw.sample(range(len(t)), n):
            t[at] = "x"
        return "".join(t)

    for _ in range(20):
        w = [word(8) for _ in range(80)]
        out.append(("long", " ".join(w), " ".join(typos(x, 1) if i % 3 == 0 else x for i, x in enumerate(w))))
        for n in (6, 12, 60):
            w = [word(draw.randint(5, 9)) for _ in range(n)]
            out.append(("dense", " ".join(w), " ".join(typos(x, 1) if i % 2 == 0 else x for i, x in enumerate(w))))
        for n in (60, 100, 600):
            z = "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(n))
            out.append(("unspaced", z, typos(z, 1)))
        u = f"https://www.{word(20)}.example/{word(20)}/{word(12)}"
        out.append(("unspaced", u, typos(u, 1)))
    return out


def test_line_dedup_recall_of_dense_edits_and_unspaced_lines(spark):
    pairs = hard_pairs()
    assert all(1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8 for _, a, b in pairs if len(a) < 200)
    rows = [(k, f"{a}\n{b}") for k, (_, a, b) in enumerate(pairs)]
    gone = {r.doc_id: r._n_removed for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    share = {kind: sum(gone[k] for k, p in enumerate(pairs) if p[0] == kind) / sum(p[0] == kind for p in pairs) for kind in ("long", "dense", "unspaced")}
    print(len(pairs), share)
    assert share["long"] >= 0.9 and share["dense"] >= 0.8 and share["unspaced"] == 1


def test_line_dedup_compares_only_lines_that_share_words(spark, monkeypatch):
    """Lines with the same two longest words meet in a bucket, but only copies are compared in characters."""
    draw, seen, middles = random.Random(3), [], linededup.middles
    word = lambda: "".join(draw.choice("abcdefghiklmnoprstuvw") for _ in range(6))
    lines = [" ".join([word() for _ in range(20)] + ["international", "understanding"]) for _ in range(40)]
    rows = [(k, x) for k, x in enumerate(lines)] + [(100, edited(draw, lines[7], 1))]
    monkeypatch.setattr(linededup, "middles", lambda both: seen.append(both.count()) or middles(both))
    assert [r.doc_id for r in linededup.dedup_lines(frame(spark, rows)).collect() if r._n_removed] == [100]
    assert sum(seen) <= 3


def test_line_dedup_distance_of_middles(spark):
    draw, pairs = random.Random(4), []
    for k in range(120):
        a = [draw.choice(["a", "bc", "def", "日本", "ghij"]) for _ in range(draw.randint(1, 12))]
        b = list(a)
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 1)] = [draw.choice(["x", "bc", "de"])] * draw.randint(0, 1)
        pairs.append((k, k, 9, " ".join(a), " ".join(b) or "x"))
    made = linededup.middles(spark.createDataFrame(pairs, "a int, b int, most int, na string, nb string")).selectExpr("a", "levenshtein(ma, mb) d", linededup.pieces_distance() + " p").collect()
    assert all(r.d == levenshtein(*pairs[r.a][3:]) <= r.p for r in made) and len(made) == len(pairs)


def test_line_dedup_without_broadcasts(spark, monkeypatch):
    """Beyond a bound that the driver holds, tables of lines are joined by shuffles, with the same result."""
    rows = [(k, f"{a}\n{b}") for k, (_, a, b) in enumerate(line_pairs()[::6])]
    want = sorted(tuple(r) for r in linededup.dedup_lines(frame(spark, rows)).collect())
    monkeypatch.setattr(linededup, "BROADCAST", 0)
    out = linededup.dedup_lines(frame(spark, rows))
    assert sorted(tuple(r) for r in out.collect()) == want


def removed(rows):
    first, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in first:
                gone.update(range(k, k + 20))
            first.add(window)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(spark):
    draw = random.Random(3)
    rows = []
    for i in range(150):
        w = [draw.choice("ab") if i % 3 == 0 else draw.choice(WORDS) for _ in range(draw.randint(0, 90))]
        if i % 4 == 1:
            w = [*w, *[f"p{k}" for k in range(60)], *w[:5]]  # a passage in many documents
        if i % 5 == 2:
            w = [*(["x", "y", "z"] * draw.randint(1, 20)), *w]  # a period
        rows.append((i, "  ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, rows[7][1]), (1003, rows[7][1]), (None, rows[9][1])]
    docs = frame(spark, rows).repartition(5)
    want = removed(rows)
    assert {r.doc_id: tuple(r)[1:] for r in substring.digest_repeats(docs).collect()} == want
    limit, substring.MOST_KEYS = substring.MOST_KEYS, -1  # without the broadcast of keys
    try:
        assert {r.doc_id: tuple(r)[1:] for r in substring.digest_repeats(docs).collect()} == want
    finally:
        substring.MOST_KEYS = limit
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == {i: v[1] for i, v in want.items()}
    assert substring.digest_repeats(docs.limit(0)).count() == 0


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0.5 * len(ids) < len(out) and {r.doc_id for r in out} <= ids and len({r.doc_id for r in out}) == len(out)


def test_no_pair_of_lines_is_compared_twice(spark, monkeypatch):
    """Lines that share buckets without being near are told apart once, whichever of them leads and whatever else they share."""
    draw, seen, verified = random.Random(5), [], linededup.verified
    shared = ["".join(draw.choice("abcdefghij") for _ in range(9)) for _ in range(9)]
    lines = [" ".join([*draw.sample(shared, 7), *("".join(draw.choice("klmnopqrst") for _ in range(3)) for _ in range(12))]) for _ in range(24)]
    rows = [(i, f"{t}\n{t[:-1]}x" if i % 8 == 0 else t) for i, t in enumerate(lines)]

    def counted(texts, pairs):
        seen.append([tuple(sorted((r.a, r.b))) for r in pairs.collect()])
        return verified(texts, pairs)

    monkeypatch.setattr(linededup, "verified", counted)
    got = {r.doc_id: r._n_removed for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i % 8 == 0) for i in range(24)}
    pairs = [p for part in seen for p in part]
    assert sum(map(bool, seen)) > 1 and len(pairs) == len(set(pairs))
