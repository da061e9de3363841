"""Page text, pieces and token counts against the libraries they follow."""

import hashlib
import random
import time

import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from riskframe.llm import html_text
from riskframe.llm.html_text import content_lines, extract_pages, main_text, smooth
from riskframe.llm.pieces import decode_documents, encode_decimals, encode_documents, model, token_digests
from riskframe.llm.queries import piece_model
from riskframe.llm.token_counts import UnigramCounter, counter, token_counts

ODD = ["", " ", "  ", "a  b", " a", "a ", "\ta\n", "<s> hi </s>", "▁x▁▁ y", "𐍈é\x00z", "a\r\n b ", "日本語テキスト" * 30, "a" * 3000, "ab" * 900, "é́ ﬁ", "word " * 5000]


def texts():
    rng = random.Random(2)
    mixed = ["".join(rng.choice(" ▁\nabcdeétionrsmb<0x>日😀\t  ") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    long = ["".join(rng.choice("tionrsmebadlh") for _ in range(rng.randint(100, 900))) for _ in range(10)]
    return ODD + mixed + long


def test_pieces_equal_the_library():
    path = piece_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    m = model(path)
    for text, ids in zip(texts(), encode_decimals(path, texts())):
        want = sp.encode(text, add_eos=True)
        assert ids == " ".join(map(str, want))
        assert m.decode(ids.split(" ")) == sp.decode(want)


def test_decoding_any_ids_equals_the_library():
    path = piece_model()
    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=path), model(path), random.Random(6)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(270), rng.randrange(3, 259), 28_705]) for _ in range(rng.randint(0, 8))]
        assert m.decode(map(str, ids)) == sp.decode(ids)


def test_round_trip_and_digests(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(99, None, "x"), (None, "no id", "x"), (1, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    back = decode_documents(encode_documents(docs, piece_model()), piece_model()).collect()
    want = {i: sp.encode(t or "", add_eos=True) for i, t, _ in rows}
    assert {r["doc_id"]: list(r["ids"]) for r in back} == want and {r["doc_id"]: r["text"] for r in back} == {i: sp.decode(v) for i, v in want.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = token_digests(docs, piece_model()).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = want[r["doc_id"]]
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    assert token_digests(docs.where("false"), piece_model()).count() == 0


def unigram(pieces, byte_pieces):
    tk = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_pieces))
    tk.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda t: len(tk.encode(t, add_special_tokens=False).ids)


def test_counts_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    plain = lambda i: not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
    count = unigram([(sp.id_to_piece(i), float(sp.get_score(i)) if plain(i) else -1e9) for i in range(sp.get_piece_size())], True)
    own = counter(piece_model())
    for t in texts():
        assert own.text(t)[0] == count(t), repr(t[:80])


@pytest.mark.parametrize("byte_pieces", [False, True])
def test_counts_with_ties_and_unknown_runs(byte_pieces):
    pieces = {"▁": -1.0, "a": -1.0, "b": -2.0, "ab": -3.0, "▁a": -2.0, "ba": -3.0, "aba": -4.0, "xy": -1.5, "b▁": -9.0}
    vocab = [("<unk>", 0.0), *pieces.items(), *([(f"<0x{b:02X}>", -20.0) for b in range(256)] if byte_pieces else [])]
    least = min(s for _, s in vocab) if byte_pieces else min(pieces.values())
    own = UnigramCounter(pieces, byte_pieces)
    own.unknown = least - 10.0
    count, rng = unigram(vocab, byte_pieces), random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("aabb xyé") for _ in range(rng.randint(0, 12)))
        assert own.text(t)[0] == count(t), repr(t)


def test_counts_of_rows(spark):
    docs = spark.createDataFrame([(1, "two words", "c"), (2, None, "c"), (None, "", "c"), (1, "two words", "c")], "doc_id long, text string, score string")
    found = sorted((r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in token_counts(docs, piece_model()).collect())
    two = counter(piece_model()).text("two words")
    assert found == [(0, 0, 0.0), (1, *two), (1, *two), (2, 0, 0.0)]
    assert token_counts(docs.where("false"), piece_model()).count() == 0


PAGE = """<html><head><title>Head</title><style>p{}</style><script>var t="</p><p>x";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href=x>Menu one</a><li><a>Menu two</a></ul></nav><!-- ad -->
<div class="ad banner">Buy this</div><div id="cookie-notice">We use cookies, a long sentence about how many cookies we use today.</div>
<article><h1>A title &amp; more</h1><p>First <b>bold  text</b>
 goes on &lt;here&gt;.<br><p>Short.<p>Second paragraph with&nbsp;many words in it, so that its ratio is high enough to be content.</p>
<form><input>Sign up <button>Go</button></form><aside>Related</aside></article>
<div class="comments"><p>A reader says something very long about the article, with many words, but it is no part of it.</p></div>
<footer>&copy; us</footer></body></html>"""


def test_page_keeps_the_article_only():
    assert main_text(PAGE) == (
        "A title & more\nFirst bold text goes on <here>.\nShort.\nSecond paragraph with many words in it, so that its ratio is high enough to be content."
    )
    plain = PAGE.replace("<article>", "<div class=story>").replace("</article>", "</div>")
    assert main_text(plain) == main_text(PAGE)


def test_page_lines_and_smoothing():
    assert smooth([5.0] * 7) == pytest.approx([5.0] * 7) and smooth([0.0, 0.0, 9.0, 0.0, 0.0])[2] < 9
    lines = [("x" * n, 1, ()) for n in (3, 4, 3, 200, 180, 220, 4, 3)]
    assert set(content_lines(lines)) >= {3, 4, 5} and not {0, 7} & set(content_lines(lines))
    assert [main_text(h) for h in (None, "", "bare words", "<p>a<p>b", "<nav>only</nav>", "<p>open <b>tag", "<p>a</p><!-- b <p>c", "<p>a<script>b")] == ["", "", "bare words", "a\nb", "", "open tag", "a", "a"]


def test_pages_of_rows(spark):
    long = "<article>" + "<p>many words stand here</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", PAGE, "t"), (3, "w", long, "t")], "page_id long, url string, html string, text string")
    rows = extract_pages(pages).collect()
    assert len(rows) == 5 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [r["text"].count("\n") for r in rows if r["page_id"] == 3] == [19_999]
    assert extract_pages(pages.where("false")).count() == 0


LONG_P = "<p>" + "A long sentence of the article, with many plain words in it. " * 3 + "</p>"
LINE = ("A long sentence of the article, with many plain words in it. " * 3).strip()


def test_clusters_choose_the_region(monkeypatch):
    links = "".join(f"<div><a href='/{i}'>Topic {i}</a> <a href='/x{i}'>more</a></div>" for i in range(9))
    page = f"<body><div id='top'>{links}</div><div id='story'><h2>Head</h2>{LONG_P * 3}<div>end.</div></div><div id='low'>{links}</div></body>"
    right = "\n".join(["Head", LINE, LINE, LINE, "end."])
    assert html_text.main_text(page) == right
    monkeypatch.setattr(html_text, "clusters", lambda ratios: (list(range(len(ratios))), 0.0))
    assert html_text.main_text(page) != right and "Topic 3" in html_text.main_text(page)


def test_marks_on_wrappers_and_compounds():
    three = "\n".join([LINE] * 3)
    for open_, close in (('<div class="content has-sidebar">', "</div>"), ("<form>", "</form>"), ('<div class="search">', "</div>"), ('<div class="no-ads"><form id="aspnet">', "</form></div>")):
        assert html_text.main_text(f"<body><nav>Menu</nav>{open_}{LONG_P * 3}{close}<footer>Foot</footer></body>") == three
    kept = f'<p class="social-security">{LINE}</p><div id="search-algorithms">{LONG_P}</div>'
    gone = '<div class="ad-slot">Buy now</div><div class="ad-partner">Buy now</div><div class="ad">Buy it</div><form>Name</form><section class="comments">' + LONG_P * 2 + "</section>"
    assert html_text.main_text(f"<article>{LONG_P}{kept}{gone}</article>") == three
    assert html_text.main_text(f"<div><div>{LONG_P * 2}</div><div class='comments'>{LONG_P * 9}</div></div>") == "\n".join([LINE] * 2)


def test_deep_and_unclosed_pages_take_linear_time():
    n, start = 100_000, time.time()
    assert html_text.main_text("<div>x" * n).count("x") >= 0.9 * n  # the innermost element with nine tenths of the text
    assert time.time() - start < 20
    for page in ("<b>" * n + "<p>x</p>" * n, "<div>" * n + "<li>x</li>" * n, "<div>" * n + "</p>" * n):
        html_text.main_text(page)
    assert time.time() - start < 60


def test_a_million_letters_in_few_rounds():
    path = piece_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng, start = random.Random(3), time.time()
    texts = ["a" * 1_000_000, "aab" * 50_000, "-" * 99_999, "0" * 12_345, "".join(rng.choice("ab") for _ in range(20_000)), "".join(rng.choice("etaoin") for _ in range(3_000))]
    for text, found in zip(texts, encode_decimals(path, texts)):
        assert found == " ".join(map(str, [*sp.encode(text, num_threads=1), sp.eos_id()]))
    assert time.time() - start < 60
