"""Tokens, fingerprints, personal data, pages, grades and mixing on small awkward tables."""

import base64
import hashlib
import html
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusgraph.llm import bpe, catalog, fingerprint, mixing, ordinal, personal, sitetree, tokenfile

WEIRD = [None, "", " ", "  ", "a  b", "a \n b", "\n", "\n\n a", " a", "a ", "x\t y", "<|endoftext|> x", "don't  'll x's",
         "　 a 　", "é   è12 34abc!!", " \x1c a", "x" * 400, "ééé" * 60, "日本語のテキスト 123", "\U0001f600 ‍ ok"]
_R = random.Random(3)
WEIRD += ["".join(_R.choice(" \n\tab1!'é日s") for _ in range(_R.randrange(40))) for _ in range(150)]
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def weird(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(WEIRD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n int").repartition(3)


def test_bpe_equals_the_library_and_decodes_back(spark, weird):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {x["id"]: x for x in bpe.encode_texts(weird, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(WEIRD)
    for k, text in enumerate(WEIRD):
        want = library.encode_ordinary(text or "")
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == want and got[k]["n_tokens"] == len(want)
        assert bytes(got[k]["decoded"]) == (text or "").encode()
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_blocks_do_not_matter(spark, monkeypatch):
    rows = [(None, "one two one"), (1, "one two one"), (1, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(bpe, "BLOCK_CHARACTERS", 10)
    small = sorted(map(str, bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, digest=True).collect()))
    monkeypatch.undo()
    assert small == sorted(map(str, bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, digest=True).collect()))


def test_bpe_folds_a_word_of_many_blocks_once(spark, monkeypatch):
    """Words of all blocks meet in shares: each is folded in one, and every block gets its ids from all of them."""
    texts = [None, "", "alpha gammaray", "gammaray alpha  epsilonic", "", "x" * 500, "日本語 gammaray", None] * 3
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(bpe, "BLOCK_ROWS", 3)
    monkeypatch.setattr(bpe, "SPLIT_ROWS", 2)
    monkeypatch.setattr(bpe, "SHARE_WORDS", 4)
    got = {x["id"]: x for x in bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN).collect()}
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted(got) == list(range(len(texts)))
    for k, text in enumerate(texts):
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == library.encode_ordinary(text or "")
        assert bytes(got[k]["decoded"]) == (text or "").encode()


def test_bpe_of_texts_without_words(spark):
    """Blocks to which no share hands anything still give their documents."""
    docs = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    got = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, (x["id"] for x in got))) == ["1", "2", "None"]
    assert all(x["n_tokens"] == 0 and bytes(x["ids"]) == bytes(x["decoded"]) == b"" for x in got)


def test_bpe_rank_map_holds_every_pair_and_always_ends():
    """A shift is found wherever one is free, however rare; where none is, the table grows."""
    ranks = bpe.read_ranks(RANKS)
    shift, cells = bpe.merge_table(RANKS)
    pairs = [(ranks[w[:k]], ranks[w[k:]], n) for w, n in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
    a, b, rank = (np.array(x) for x in zip(*pairs))
    assert (cells[shift[a] + b] == a * 2**bpe.BITS + rank).all()
    assert (cells != bpe.NONE).sum() == len(pairs) and len(cells) >= shift.max() + len(ranks) + 1
    rare = np.zeros(200_000, bool)
    rare[[150_007, 150_010]] = True
    draws = np.random.Generator(np.random.PCG64(1))
    assert bpe._free_shift(rare, np.array([7, 10]), 199_000, draws) == 150_000
    assert bpe._free_shift(rare, np.array([7, 11]), 199_000, draws) is None


def test_bpe_rank_map_grows_past_its_first_size(monkeypatch, tmp_path):
    pieces = [bytes([x]) for x in range(256)] + [b"ab", b"abc", b"bc", b"ac"]
    ranks = tmp_path / "few.tiktoken"
    ranks.write_bytes(b"".join(base64.b64encode(x) + b" %d\n" % k for k, x in enumerate(pieces)))
    found, asked = bpe._free_shift, []
    monkeypatch.setattr(bpe, "_free_shift", lambda free, *rest: asked.append(len(free)) or (None if len(asked) == 2 else found(free, *rest)))
    shift, cells = bpe.merge_table(str(ranks))
    assert asked[2] == asked[0] + len(pieces) == len(cells)
    ab, bc, rank = 256, 258, {(97, 98): 256, (97, 258): 257, (256, 99): 257, (98, 99): 258, (97, 99): 259}
    assert all(cells[shift[x] + y] == x * 2**bpe.BITS + n for (x, y), n in rank.items()) and (cells != bpe.NONE).sum() == len(rank)
    assert cells[shift[ab] + bc] >> bpe.BITS != ab


def test_bpe_share_lists_each_word_once():
    """Blocks that hold the same words give one list to fold."""
    words = [b"gammaray", b" alpha", "日本".encode()]
    sizes = np.array([len(w) for w in words], "<u4")
    table = pa.table({"share": [0, 0], "block": [7, 9], "raw": [bpe._pack(np.frombuffer(b"".join(words), np.uint8)),
                      bpe._pack(np.frombuffer(b"".join(words[::-1]), np.uint8))], "sizes": [sizes.tobytes(), sizes[::-1].tobytes()]})
    row = bpe._distinct(RANKS)(table).to_pylist()[0]
    ranks = bpe.read_ranks(RANKS)
    assert row["words"] == [[ranks[w]] if w in ranks else [ranks[bytes([b])] for b in w] for w in words]
    assert row["blocks"] == [7, 9] and [bpe._from_planes(pa.scalar(x)).tolist() for x in row["numbers"]] == [[0, 1, 2], [2, 1, 0]]


def test_bpe_splits_a_block_some_rows_at_a_time(spark):
    """A block leaves its worker a few documents a row, so that no row grows with the block."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(600)], "id long, text string").coalesce(1)
    rows = docs.mapInArrow(bpe._blocks(public_tokenizers.PATTERN), (
        "block bigint, n_words bigint, raw binary, sizes binary, ids array<bigint>, numbers binary, lengths binary")).collect()
    assert [len(x["ids"]) for x in rows] == [256, 256, 88, 0]
    assert [x["raw"] is not None for x in rows] == [False, False, False, True]


def test_token_file_round_trip(spark, weird, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 300)
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(weird, path, JSON, public_tokenizers.PATTERN, end=0)
    got = {x["id"]: x for x in tokenfile.read_tokens(spark, path).collect()}
    crc = {x["id"]: x["ids_crc32"] for x in tokenfile.read_tokens(spark, path, digest=True).collect()}
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    start = 0
    for k, text in enumerate(WEIRD):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], bytes(got[k]["ids"])) == (start, len(ids), ids.tobytes())
        assert crc[k] == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_token_file_query_knows_the_added_tokens(spark, tmp_path):
    texts = ["a <|endoftext|> b", "plain", None, "<|endoftext|><|endoftext|>", "x<|endoftext|>y  <|endoftext|>  z\n", "<|endoftext", "", "last one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in catalog.QUERIES["op4_token_file"](spark, str(tmp_path)).collect()}
    library, start = Tokenizer.from_file(JSON), 0
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for k, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_file_of_an_empty_table_and_of_null_ids(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    tokenfile.write_tokens(empty, str(tmp_path / "none"), JSON, public_tokenizers.PATTERN)
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).collect() == []
    rows = spark.createDataFrame([(None, "b"), (2, "a a"), (2, "a a")], "doc_id long, text string")
    tokenfile.write_tokens(rows, str(tmp_path / "some"), JSON, public_tokenizers.PATTERN)
    got = sorted((x["start"], x["id"]) for x in tokenfile.read_tokens(spark, str(tmp_path / "some")).collect())
    assert got == [(0, 2), (3, 2), (6, None)]


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000])
def test_huffman_codes(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n) - 1, 40_000)
    lengths = tokenfile.limited_lengths(np.bincount(ids, minlength=3), 16)
    code = tokenfile.CanonicalCode(lengths)
    stream, gaps = code.encode(ids)
    assert (code.decode(stream, n, gaps.astype(np.int64)) == ids).all() if n else not stream
    if len(set(ids.tolist())) > 1:
        assert abs((2.0 ** -lengths[lengths > 0].astype(float)).sum() - 1) < 1e-12 and lengths.max() <= 16


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_fingerprints_and_edited_texts(spark):
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(r.choice([0, 1, 4, 20, 900]))) for _ in range(60)]
    texts += [texts[4], None, "  "]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    got = {x["id"]: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, part string")).collect()}
    assert len(got) == len(rows)
    for k in range(len(texts)):
        text, following = texts[k] or "", texts[k - 1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert got[k]["n_chars"] == len(text)
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[k]["near_edited"] - true) < 0.2
        assert 0 <= got[k]["near_next"] <= 1
    assert got[4]["fingerprint"] == got[60]["fingerprint"]
    one = fingerprint.fingerprints(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and personal.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("a.@1 2-+(3)%9é") for _ in range(r.randrange(40)))
        assert personal.base_spans(text) == plain_spans(text)
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")
    assert personal.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_personal_data_knows_ascii_digits_only(spark):
    texts = ["¹²³¹²³¹²³¹²³¹²³ [at] example [dot] com", "٣٣٣٣٣٣٣٣٣٣٣٣٣٣٣٣ card ٣٣٣-٣٣-٣٣٣٣ Ⅻ①", "1." + "0" * 6000 + "2.3.4 " + "9" * 6000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: x for x in personal.find_personal(docs).collect()}
    assert got[0]["spans"].startswith("email:") and got[1]["spans"] == "" and got[2]["n_ip"] == 1
    assert personal.redact_personal(docs).count() == 3


def test_many_spans_of_one_text_are_kept_apart():
    r = random.Random(8)
    for _ in range(200):
        draw = lambda n: [(r.choice("xy"), a, a + r.randrange(1, 6)) for a in (r.randrange(60) for _ in range(n))]
        base, wanted = draw(r.randrange(6)), draw(r.randrange(20))
        want, taken = [], [(a, b) for _, a, b in base]
        for kind, a, b in wanted:
            if all(b <= c or a >= d for c, d in taken):
                want.append((kind, a, b))
                taken.append((a, b))
        assert personal._apart(base, wanted) == want
    begin = time.perf_counter()
    many = [("x", 7 * k, 7 * k + 8 - k % 3) for k in range(200_000)]
    assert len(personal._apart(many[::5], many)) > 50_000 and time.perf_counter() - begin < 10


def test_personal_data_rows_and_redaction(spark):
    rows = [(1, "write to ann.b@mail.example.com or 10.0.0.1, +1 (555) 555-0100"), (2, None), (3, ""),
            (4, 'a token = "2321bac4d15ec8f90433955bf9d3cf6aa0b1c2d3" here'), (None, "clean text of 12 words, no. 3.14"),
            (6, "card 4111 1111 1111 1111!")]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, spans string")
    got = {x["id"]: x for x in personal.find_personal(docs).collect()}
    assert [got[1][f"n_{k}"] for k in personal.BASE_KINDS] == [1, 1, 0, 1] and got[6]["n_card"] == 1
    for i, text in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert got[None]["spans"] == got[2]["spans"] == got[3]["spans"] == ""
    assert got[4]["spans"].startswith("secret:")
    masked = {x["doc_id"]: x["text"] for x in personal.redact_personal(docs).collect()}
    assert masked[1] == "write to [EMAIL] or [IP], [PHONE]" and masked[2] is None and masked[6] == "card [CARD]!"
    assert masked[None] == rows[4][1] and "[SECRET]" in masked[4]


def test_boosted_candidates_on_held_out_lines():
    model, levels = personal.trained()
    x, y, kinds = personal._examples(1500, 1234)
    accepted = model.probability(x) >= levels[kinds]
    assert y[accepted].mean() > 0.98 and accepted[y == 1].mean() > 0.9


def test_main_text_drops_what_is_not_the_article(spark):
    def page(body, k):
        return (f"<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>"
                f"<div class='ad'>Buy {k}</div><div class='box'>Same on all pages</div><div class='lead'>Lead {k}</div>"
                f"<article><h1>Title {k}</h1><p>{body}<br>more <b>bold</b><p>Second &amp; last</p><script>x('</p>')</script>"
                f"<form><input>Send</form><section class='comments'><p>Nice!</p></section></article><aside>See also</aside>"
                f"<footer>&copy; me</footer>")
    rows = [(k, f"http://h.example.com/{k}", page(f"Body  {k}\n text &lt;tag&gt;", k), "x") for k in range(6)]
    rows += [(90, None, None, "x"), (91, "u", "", "x"), (92, "http://other/", "<p>plain<p>text", "x"), (None, "http://o2/", "<b>no block", "x")]
    got = {x["page"]: x for x in sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, path string")).collect()}
    for k in range(6):
        assert got[k]["text"] == f"Lead {k}\nTitle {k}\nBody {k} text <tag> more bold\nSecond & last"
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert got[90]["text"] == got[91]["text"] == "" and got[92]["text"] == "plain\ntext" and got[None]["text"] == "no block"
    assert html.unescape("&amp;") == "&"


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><body><article><p>one<p>two</article>",
    "<html><head><title>x</title><meta charset=u><p>one<p>two",
    "<html><head><title>x</title>one<p>two",
    "<head><noscript><link><body><p>one<p>two",
    "<head><noscript><p>no</p></noscript><title>x</title></head><body><p>one<p>two",
    "<body><div><p>one</p><noscript><div>no</div>no</div><p>two",
    "<body><div>one<svg><g><text>no</text></g></div><p>two",
    "<body><div>one<object><object>no</object>no</object></div><p>two",
    "<body><div>one<template><p>no</div><div>two</div>",
])
def test_unclosed_unseen_elements_do_not_take_the_page(page):
    assert [text for *_, text in sitetree.read_page(page)[0]] == ["one", "two"]


@pytest.mark.parametrize("tag", ["<div class='content-block'>", "<center>", "<li>", "<p><section>"])
def test_depth_costs_no_more_than_the_page(tag):
    tracemalloc.start()
    begin = time.perf_counter()
    blocks, _ = sitetree.read_page(tag * 50_000 + "<p></p></b>" * 20_000 + "deep")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [text for *_, text in blocks] == ["deep"] and peak < 150e6 and time.perf_counter() - begin < 30


def main_texts(spark, pages):
    rows = [(k, f"http://h{host}/", html) for k, (host, html) in enumerate(pages)]
    got = sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [x["text"] for x in sorted(got, key=lambda x: x["page"])]


def test_names_of_states_and_wrappers_do_not_take_the_article(spark):
    pages = ["<body class='has-sidebar'><article>a", "<form><div><article><p>a</article></div>no</form>", "<div class='post comments-open'><p>a</div>",
             "<article><header><h1>a</h1></header><p>b</article>", "<div class='sidebar-layout'><div><main>a</main></div></div>",
             "<section id=comments><article>no</article></section><p>a", "<aside><article>no</article></aside><p>a", "<div class=header>no<article>a",
             "<div class='promo-box'>no</div><p>a", "<div class='comment-list'>no</div><p>a", "<article>a<div class='cookie-bar'>no"]
    assert main_texts(spark, list(enumerate(pages))) == ["a", "a", "a", "a\nb"] + ["a"] * 7


def test_importance_decides_where_a_host_has_pages(spark):
    def page(k):
        return (f"<div class=x1><span>Top story</span></div><div class=x2><p>Body {k} of page<p>We use cookies<p>more {k}</div>"
                f"<div class='promo-box'>Deal {k}</div><div class='promo-card'>Buy {k % 2}</div>"
                f"<main><p>Main {k} is long enough<p>Accept our terms<p>End {k}</main><div class=x3>About us</div>")
    want = [f"Body {k} of page\nWe use cookies\nmore {k}\nDeal {k}\nMain {k} is long enough\nEnd {k}" for k in range(12)]
    copies = ["<main><p>one<p>two</main><div class=x3>About"] * 4 + ["<main><p>one<p>two<p>extra</main><div class=x3>About"] * 2
    got = main_texts(spark, [(0, page(k)) for k in range(12)] + [(1, x) for x in copies])
    assert got[:12] == want
    assert got[12:] == ["one\ntwo"] * 4 + ["one\ntwo\nextra"] * 2


def test_node_importance_equals_a_plain_computation(spark):
    r = random.Random(12)
    pages = []
    for k in range(60):
        parts = [f"<div class={c}><p>{r.choice('abcdef')}" + r.choice(["", "<p>z", "<ul><li>1"]) + "</div>" for c in r.sample("xyz", r.randrange(1, 4))]
        pages.append((f"http://h{k % 3}/{k}", "".join(parts) + f"<article>{r.randrange(30)}"))
    rows = [(k, u, t) for k, (u, t) in enumerate(pages)]
    read = sitetree.read_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    got = {(x["host"], x["path"]): (x["pages"], x["importance"]) for x in sitetree.node_importance(read, sitetree.text_counts(read)).collect()}
    hosts = {x["page"]: x["host"] for x in read.collect()}
    by_host = {}
    for k, (_, html) in enumerate(pages):
        blocks, styles = sitetree.read_page(html)
        article = tuple(t for *_, role, t in blocks if role == "+")
        by_host.setdefault(hosts[k], []).append((k, article, blocks, styles))
    want = {}
    for host, known in by_host.items():
        texts, paths, shown, parent = {}, {}, {}, {}
        for k, article, blocks, styles in known:
            for path, above, role, text in blocks:
                unit = article if role == "+" else k  # copies of an article count once inside it
                texts.setdefault(path, {}).setdefault(text, set()).add(unit)
                paths.setdefault(path, set()).add(unit)
                parent[path] = above
            for path, style in styles.items():
                shown.setdefault(path, {}).setdefault(style, set()).add(k)
        for path, held in texts.items():
            m = len(paths[path])
            content = 1.0 if m == 1 else 1 - sum(math.log(len(x)) / math.log(m) for x in held.values()) / len(held)
            styles = [len(x) for x in shown[parent[path]].values()]
            total = sum(styles)
            presentation = 1.0 if total == 1 else -sum(n / total * math.log(n / total) for n in styles) / math.log(total)
            want[host, path] = (m, 0.9 * content + 0.1 * presentation)
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-9 for x in want)


def test_copies_of_an_article_keep_their_text(spark):
    rows = [(k, "http://h/", "<body><article><p>the very same</article><div class=x>common</div></body>") for k in range(8)]
    got = sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x["text"] for x in got} == {"the very same"}


def test_ordinal_grades_follow_marked_words(spark):
    r = random.Random(6)
    plain = [f"w{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(1200):
        words = r.choices(plain, k=r.randrange(5, 60))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(r.choice([1, 1, 4])):
                words.insert(r.randrange(len(words)), r.choice(["vile", "nastyish", "nastyest"]))
        docs.append((k, " ".join(words), "x"))
        if k % 2 == 0:
            labels.append((k, int(toxic), 0))
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "vile vile vile", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, key string")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = ordinal.train(d, lab)
    got = {x["id"]: x for x in ordinal.grade(d, model).collect()}
    held_out = [k for k in range(1200) if k % 2]
    assert all(got[k]["rejected"] == (k % 5 == 0) for k in held_out)
    assert not got[5000]["rejected"] and not got[5001]["rejected"] and got[None]["rejected"]
    one, many = model.score("vile"), model.score("vile vile nastyish nastyest vile")
    low, high = model.at_least(np.array([one, many])).sum(axis=1)
    assert 0 < low < high <= 2 and model.borders[0] < model.borders[1]
    assert ordinal.without_toxic(d.drop("key"), model).count() == sum(not x["rejected"] for x in got.values())
    nothing = ordinal.train(d, lab.filter("false"))
    assert ordinal.grade(d, nothing).filter("rejected").count() == 0


def test_ordinal_fit_recovers_shared_weights_and_borders():
    r = np.random.default_rng(1)
    n = 4000
    x = r.integers(0, 2, (n, 3)).astype(float)
    y = (x @ np.array([3.0, 1.5, 0.0]) + r.logistic(size=n))
    grades = (y > 1).astype(int) + (y > 3)
    rows, columns = np.nonzero(x)
    weight, borders = ordinal.fit_ordinal(rows, columns, x[rows, columns], grades, 3, 3)
    assert np.abs(weight - [3.0, 1.5, 0.0]).max() < 0.35 and np.abs(borders - [1, 3]).max() < 0.3


def test_mixing_targets_and_repeats(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["a", "b", "b", "b", "c", None]), "w " * r.choice([0, 1, 5, 40]), 1.0) for k in range(3000)]
    rows += [(9000, "tiny", "w", 1.0), (9001, "none", None, 1.0), (9002, "none", "", 1.0), (None, "a", "w w", 1.0), (None, "a", "w w", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target double")
    got = mixing.mix(docs, mixing.word_count(F.col("text"))).collect()
    again = mixing.mix(docs.repartition(7), mixing.word_count(F.col("text"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for x in got:
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        target[x["source"]] = x["target"]
        assert x["taken"] == x["size"] * x["repeats"] <= 3 * x["size"]
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    free, share = set(sizes), {}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in sizes if s not in free)
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        free -= over
    for s in sizes:
        assert target[s] == pytest.approx(share[s] if s in free else 3 * sizes[s])
        assert abs(taken[s] - target[s]) <= 40
    assert mixing.mix(docs.limit(0), mixing.word_count(F.col("text"))).collect() == []


def test_wordless_rows_are_taken_no_more_than_the_epochs(spark):
    rows = [(k, "a", "") for k in range(60)] + [(100 + k, "a", "one two three") for k in range(3)] + [(k, "b", "word " * 400) for k in range(200, 220)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, mixing.word_count(F.col("text"))).collect()
    assert max(x["repeats"] for x in got) <= 3 and {x["repeats"] for x in got if x["source"] == "a"} == {3}
