"""Archives, pages, pieces, languages, Hamming search and the pipeline on small tables."""

from __future__ import annotations

import collections
import gzip
import hashlib
import random
import zlib
from base64 import b32encode

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from codonlake.llm import hamming, html, language, pieces, warc
from codonlake.session import scratch_path


def prose(seed: int, n: int, letters: str = "abcdefghiklmnorstu") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))


PAGES = [
    (0, "http://a/1", "<p>one</p>"),
    (1, "http://a/2", "<p>one</p>"),
    (2, None, None),
    (3, "http://a/\r\nX: y", ""),
    (4, "u", "two\r\n\r\nparts\r\n\r\n"),
    (5, "http://ü/é", "é" * 5000),
    (6, "u", "<p>one</p>"),
    (None, "u", "<p>one</p>"),
    (8, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
]


@pytest.mark.parametrize("extra", [[], [(9, "u", "in\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n")]])
def test_archives_round_trip(spark, extra):
    rows = PAGES + extra
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r) for r in warc.archive_round_trip(df).collect()]
    digest = lambda h: b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    last = {}
    for i, _, h in rows:
        last[digest(h)] = max(last.get(digest(h), -1), -1 if i is None else i)
    want = [
        (i, len((h or "").encode()), digest(h), "response" if last[digest(h)] == i else "revisit", None if last[digest(h)] == i else last[digest(h)])
        for i, _, h in rows
    ]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_payloads_come_back(spark):
    rows = PAGES + [(9, "u", "in\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "payloads")
    warc.write_archives(warc.records(df), path)
    got = {r["page_key"]: r["payload"] for r in warc.read_archives(spark, path).filter("record_type = 'response'").collect()}
    assert got == {str(i): h or "" for i, _, h in rows if i in (3, 4, 5, 6, 8, 9)}


def test_small_payloads_are_no_revisits(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.archive_round_trip(df, min_bytes=11).collect()
    assert {r["record_type"] for r in got} == {"response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archives_are_plain_warc(spark):
    df = spark.createDataFrame([(1, "u", "é"), (2, "u", "é")], "page_id long, url string, html string").coalesce(1)
    path = scratch_path(spark, "plain")
    warc.write_archives(warc.records(df), path)
    [name] = [r[0] for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    data = gzip.decompress(bytes(name))
    heads = data.count(b"WARC/1.1\r\n")
    assert heads == 2 and data.endswith(b"\r\n\r\n") and b"Content-Length: 2\r\n\r\n\xc3\xa9\r\n\r\n" in data
    assert b"WARC-Type: revisit\r\n" in data and warc.PROFILE.encode() in data


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var t="</p><p>no";</script></head><body>
<header class="site">Brand <b>name</b></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy this now and save a lot of money on things that nobody needs at all today</div>
<div class="cookie-notice">We use cookies</div><aside>Side words</aside>
<article><h1>The  Title</h1><p>A &amp; B &lt;c&gt; caf&eacute;&#33;<p>Short.<div class="advert">An advert</div>
<p data-x="a>b">More<br>text</p><form><input value="q"><button>Send</button> label</form><section id="comments"><p>Reader says no</p></section>
<p>End.</p></article><footer>&copy; someone</footer></body></html>"""


def test_main_text_of_pages(spark):
    text = "The Title A & B <c> café! Short. More text End."
    pages = [PAGE, None, "", "<p", "plain words only", "<article>cut &am", PAGE.replace("\n", "") * 2, "<article><p>" + "w " * 50_000]
    want = [text, "", "", "", None, "cut &am", f"{text} {text}", ("w " * 50_000).strip()]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.page_texts(df).collect()}
    for i, w in enumerate(want):
        if w is not None:
            assert got[i]["text"] == w and got[i]["n_chars"] == len(w)
    assert html.page_texts(df.limit(0)).count() == 0


def test_marks_decide():
    rng = random.Random(6)
    for _ in range(3000):
        sides = [(rng.choice([0, 1, 5, 20, 70, 300]), rng.random()) for _ in range(3)]
        features = tuple(x for pair in sides for x in pair)
        assert html._says(html.default_tree(), (*features, 1)) and not html._says(html.default_tree(), (*features, -1))


def test_pages_without_marks():
    body = " ".join(f"word{k}" for k in range(60))
    page = f"<div><a href=1>Home</a> <a href=2>About us</a></div><div>{body}</div><div>{body}</div><div><a href=3>Next page</a></div>"
    assert html.main_text(page) == f"{body} {body}"


ODD = ["", " ", "  ", "a  b", " a", "a ", "\n", "a\n\n b", "x\ty", "日本語 テスト", "🙂 emoji", "a" * 300, "the the  the   the", "▁▁", "\x00"]


@pytest.mark.parametrize(
    "opening",
    [
        '<article class="post category-social">',
        '<article class="post has-comments">',
        '<main id=x class="with-sidebar">',
        '<article class="sidebar">',
        '<div class="content no-sidebar">',
    ],
)
def test_names_with_a_part_like_surroundings(opening):
    tag = opening[1:].split()[0]
    page = f'{opening}<div class="entry-header"><h1>Title here</h1></div><p>one two</p></{tag}><div class="ad social">buy it</div>'
    assert html.main_text(page) == "Title here one two"


@pytest.mark.parametrize("empty", ["<svg/>", '<svg class="a>b" />', '<math alt="x"/>', "<SVG width=1 />"])
def test_self_closed_drawings_are_empty(empty):
    page = f"<article><p>before it</p>{empty}<p>after it</p><svg a='/'><text>no</text></svg><p>end</p></article>"
    assert html.main_text(page) == "before it after it end"


def test_pieces_equal_the_library(spark):
    rng = random.Random(1)
    vocabulary = pieces.Vocabulary.load()
    known = list(vocabulary.ids)
    texts = ODD + ["".join(rng.choice(known).replace("▁", " ") for _ in range(9)) for _ in range(3000)]
    texts += ["".join(rng.choice(" etaoinshrdlu\n.,THE  ") for _ in range(rng.randrange(80))) for _ in range(3000)]
    own = [np.frombuffer(b, np.int32).tolist() for b in pieces.Encoder(vocabulary).texts(texts)]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert own == library.encode(texts)
    assert [pieces.decoded(vocabulary, i) for i in own] == library.decode(own)


def test_best_paths_of_a_unigram_model():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = -4 - zlib.crc32(p.piece.encode()) % 4096 / 512
    kinds = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 5: "unused", 6: "byte"}
    v = pieces.Vocabulary([p.piece for p in model.pieces], [p.score for p in model.pieces], [kinds[p.type] for p in model.pieces], False)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [prose(k, 30) for k in range(40)]
    total = lambda ids: sum(v.scores[i] for i in ids)
    for own, other in zip(pieces.Encoder(v).texts(texts), library.encode(texts)):
        assert total(np.frombuffer(own, np.int32).tolist()) == pytest.approx(total(other))


def test_token_table(spark):
    rows = [(i, t) for i, t in enumerate([None, *ODD, "long " * 30_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.token_table(df).collect()}
    assert all(r["round_trip"] == ("▁" not in (rows[k][1] or "")) and r["n_tokens"] == len(r["ids"]) for k, r in got.items())
    assert got[0]["ids"] == [] and pieces.token_table(df.limit(0)).count() == 0


def test_languages_are_told_apart(spark):
    letters = {"xx": "abcdefgh", "yy": "efghijkl", "zz": "ijklmnéüß"}
    rows = [(k, prose(k, 4 + k % 60, letters[c]), c) for k in range(600) for c in [list(letters)[k % 3]]]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 ... 34", "zz"), (1003, prose(5, 40, "abcdefgh"), None), (1003, "abba", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.language_table(df).collect()
    want = {r[0]: r[2] for r in rows}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert r["lang_pred"] == "und"
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.97 * len(held) > 100
    assert language.language_table(df.limit(0)).count() == 0


def test_code_lengths_are_exact():
    """Against a plain recursion over counts with escapes and exclusion."""
    import pandas as pd

    text = "abracadabra abrakadabra"
    data = language._bytes(text)
    counts = collections.Counter(data[i : i + 4] for i in range(len(data) - 3))
    frame = pd.DataFrame([("l", int.from_bytes(g, "big"), n) for g, n in counts.items()], columns=["lang", "gram", "n"])
    model = language.Model(frame)

    def chance(context: bytes, symbol: int, offered: frozenset, order: int) -> float:
        if order < 0:
            return 1 / (256 - len(offered))
        after = collections.Counter()
        for g, n in counts.items():
            if g[3 - order : 3] == context[3 - order :] and g[3] not in offered:
                after[g[3]] += n
        if not after:
            return chance(context, symbol, offered, order - 1)
        whole = sum(after.values()) + len(after)
        if symbol in after:
            return after[symbol] / whole
        return len(after) / whole * chance(context, symbol, offered | frozenset(after), order - 1)

    probe = language._bytes("abrazadabka")
    bits = -sum(np.log2(chance(probe[i - 3 : i], probe[i], frozenset(), 3)) for i in range(3, len(probe)))
    assert model.lengths(["abrazadabka"])[0, 0] == pytest.approx(bits, rel=0.01)


def test_no_language_context_or_byte_is_left_out(spark):
    """Many languages with all byte values, one of them small: the same as each language by itself, in groups or not."""
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xE0, 0x17F), *range(0x400, 0x460), *range(0x4E00, 0x4E60)]]
    own = {f"l{k:02d}": "".join(rng.sample(letters, 40)) for k in range(30)}
    rows = [(k, prose(k, 80, letter), name) for k, (name, letter) in enumerate(own.items())]
    rows += [(100 + k, prose(100 + k, 400, own["l00"]), "l00") for k in range(200)] + [(900, "ab", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    probes = [(k, prose(5000 + k, 12, letter), name) for k, (name, letter) in enumerate(own.items())] + [(90, "ab", "small")]
    asked = spark.createDataFrame(probes, "doc_id long, text string, want string")
    whole, parts = language.trained(df), language.trained(df, group=20_000)
    assert len(whole) == 1 and len(parts) > 3
    assert whole[0].value.languages == sorted({*own, "small"})
    assert sum(len(t.symbols[3]) for t in whole[0].value.tables) == language.gram_counts(df).count()
    one, many = (language.identified(asked, m).orderBy("doc_id").collect() for m in (whole, parts))
    assert one == many and all(r["lang_pred"] == r["want"] for r in one)


def test_nearest_codes(spark):
    rng = random.Random(4)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(150)]
    codes += [c ^ (1 << rng.randrange(63)) for c in codes[:60]] + [codes[0]] * 30
    rows = [*enumerate(codes), (9000, None), (None, 5)]
    df = spark.createDataFrame(rows, "id long, code long")
    queries = df.filter("id % 25 = 0 OR id > 8000")
    for k in (1, 7, 400):
        got = collections.defaultdict(list)
        for r in hamming.nearest(df, queries, k).orderBy("rank").collect():
            got[r["query_id"]].append((r["distance"], r["neighbor_id"]))
        for q in range(0, len(codes), 25):
            want = sorted((bin((c ^ codes[q]) & (2**64 - 1)).count("1"), i) for i, c in enumerate(codes))[:k]
            assert got[q] == want
        assert 9000 not in got


def test_sign_codes(spark):
    vectors = [[1.0, -1.0, 0.0, 2.0], None, [], [float("nan"), 1.0], [0.5] * 64, [-1.0] * 64 + [2.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<float>")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.orderBy("id").select(hamming.binary_code(F.col("v"))).collect()]
    assert got == [0b1001, None, 0, 0b10, -1, 1]


def test_pipeline_stages(spark, tmp_path):
    texts = [prose(k, 90) for k in range(30)] + [prose(0, 90), "too short", None, prose(31, 90) + " password=abcdefgh12"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, ids = df, [set(range(34))]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert docs.columns == df.columns
        ids.append({r["doc_id"] for r in docs.collect()})
    good = set(range(31)) | {33}
    assert ids[1] == good and ids[2] == ids[3] == good - {30} and ids[4] <= ids[3] and ids[5] == ids[4]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == ids[5] and all(r["round_trip"] for r in out)
