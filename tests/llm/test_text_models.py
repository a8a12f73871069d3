"""HTML extraction, language identification, chat formatting and BPE on small tables."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lendframe.llm import chat, encode, html, language, queries

VOCABULARY = queries.vocabulary_path()


@pytest.fixture(scope="module")
def tree(spark):
    return html.fit_tree(spark, list(html.labelled_pages()))


def test_blocks_and_links():
    got = html.text_blocks("<ul><li><a href='x'>One two</a></ul><p>Tom &amp; <b>Ann</b>\n  said&nbsp;so <a>here</a><script>var t='<p>no</p>'</script><div class=ad>Buy")
    assert [b[0] for b in got] == ["One two", "Tom & Ann said so here", "Buy"]
    assert got[0][2] == 1.0 and got[1][2] == pytest.approx(1 / 6) and got[1][3:7] == [2.0, 1.0, 1.0, 0.0] and got[2][8] == 1.0


def test_main_text_of_odd_pages(table, tree):
    body = "<article><header><h1>A title</h1></header><p>First  part,\n &lt;one&gt;.</p><aside>See also this</aside><p>Second.<ul><li>item</ul>"
    given = [(1, f"<body><nav><a href=/>Home</a></nav>{body}</article><div class='comments'><p>Nice one, thank you all</p></div><footer>&copy; us</footer>", 1, "x"),
             (2, None, 1, "x"), (None, "", 1, "x"), (4, "<p>cut off in a tag <foo", 1, "x"), (5, "<article><p>" + "word " * 100_000, 1, "x"),
             (6, "<<<>>> &#x; <a <b>", 1, "x"), (2**60 + 1, "<article><p>kept<style>p{}</style></article>", 1, "x")]
    out = html.main_text(table(given, "page_id long, html string, _html int, text string"), model=tree)
    assert out.columns == ["page_id", "_html", "text", "n_blocks"]
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[1] == "A title\nFirst part, <one>.\nSecond.\nitem"
    assert got[2] == got[None] == "" and got[2**60 + 1] == "kept"
    assert got[5] == " ".join(["word"] * 100_000) and len(got) == len(given)
    assert html.main_text(table([], "page_id long, html string"), model=tree).collect() == []


def test_tree_on_layouts_it_has_not_seen(spark, table, tree):
    pages = list(html.labelled_pages(80, seed=99))
    out = html.main_text(table([(i, h) for i, (h, _) in enumerate(pages)], "page_id long, html string"), model=tree)
    right = total = 0
    got = {r["page_id"]: set(r["text"].split("\n")) for r in out.collect()}
    for i, (page, labels) in enumerate(pages):
        blocks = [b[0] for b in html.text_blocks(page)]
        right += sum((b in got[i]) == bool(y) for b, y in zip(blocks, labels))
        total += len(labels)
    assert right / total > 0.95


def test_pages_match_their_articles(spark, sf_dir, tree):
    def truth(page):
        inner = page[page.index("<article>") + 9:page.index("</article>")]
        return "\n".join(b[0] for b in html.text_blocks(f"<article>{inner}"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    want = {r["page_id"]: truth(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op1_block_tree_text"](spark, sf_dir).collect()}
    assert sum(got[k] == w for k, w in want.items()) >= 0.98 * len(want) and set(got) == set(want)


def test_language_is_found_on_held_out_rows(spark, documents, sf_dir):
    out = queries.QUERIES["op5_language_codes"](spark, sf_dir).filter("held_out")
    met = out.join(documents.filter("length(text) > 30"), "doc_id").select("lang", "lang_pred").collect()
    assert len(met) > 30 and sum(r["lang"] == r["lang_pred"] for r in met) >= 0.97 * len(met)


def test_language_of_odd_texts(table):
    train = [(i, "the cat and the dog went out", "en") for i in range(9)] + [(i, "der hund und die katze gehen", "de") for i in range(9)]
    train += [(20, None, "en"), (21, "text without label", None), (22, "", "en")]
    model = language.learn(table(train, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    given = [(1, "the dog", 1), (2, "die katze", 1), (3, None, 1), (4, " 12 !? ", 1), (5, "", 1), (None, "THE CAT " * 50_000, 1), (1, "the dog", 1)]
    out = language.identify(table(given, "doc_id long, text string, score int"), model)
    assert sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in out.collect())) == [(0, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    none = language.learn(table([], "text string, lang string"))
    assert language.identify(table(given[:1], "doc_id long, text string, score int"), none).first()["lang_pred"] == "und"
    assert language.identify(table([], "doc_id long, text string"), model).collect() == []
    one = language.learn(table([("abc", "xx")], "text string, lang string"))
    assert language.identify(table([("hello",)], "text string"), one).first()["lang_pred"] == "xx"


@pytest.mark.parametrize("k", [2, 3, 5, 9, 40])
def test_codewords_are_apart(k):
    code = language.codewords(k)
    least = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
    assert code.shape[0] == k and least >= (1 if k == 2 else 2 if k == 3 else code.shape[1] // 4)
    assert not (np.abs(code.sum(axis=0)) == k).any()


def test_preferences(table):
    turn = "struct<role:string,text:string>"
    u, a, b, c = ("user", "hi"), ("assistant", "yes"), ("assistant", "no"), ("user", "<|im_end|>é")
    given = [(1, [u, a], [u, b], 1), (2, [u, a], [u, a], 1), (3, None, [u, b], 1), (4, [], [], 1), (5, [u, a, c, a], [u, b], 1), (None, [u, (None, None)], [u, a], 1), (1, [u, a], [u, b], 1)]
    out = chat.preference_examples(table(given, f"pair long, chosen array<{turn}>, rejected array<{turn}>, _c int"))
    assert out.columns == ["pair", "_c", "n_prompt", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans", "usable"]
    by = {r["pair"]: r for r in out.collect()}
    assert by[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and by[1]["n_prompt"] == 1 and by[1]["usable"]
    assert by[2]["n_prompt"] == 2 and by[2]["chosen"] == "" and not by[2]["usable"]
    assert by[3]["n_prompt"] == 0 and by[3]["chosen"] == "" and not by[3]["usable"] and by[4]["prompt"] == ""
    spans = [by[5]["chosen"][s["start"]:s["start"] + s["length"]] for s in by[5]["chosen_spans"]]
    assert spans == ["yes<|im_end|>", "yes<|im_end|>"] and "< |im_end|>é" in by[5]["chosen"]
    assert not by[None]["usable"] and out.count() == len(given)
    empty = table([], f"pair long, chosen array<{turn}>, rejected array<{turn}>")
    assert chat.preference_examples(empty).collect() == []


def test_turns_and_pairs_of_odd_conversations(table):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (3, 0, "assistant", "x" * 100_000),
            (None, 0, "assistant", "n"), (70, 0, "assistant", "alone")]
    given = table(rows, "conv_id long, turn long, role string, text string")
    ts = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.turns(given).collect()}
    assert ts[1] == [("user", "a"), ("user", "a"), ("assistant", "b")] and ts[2] == [("", "")]
    pairs = {r["conv_id"]: r for r in chat.swapped_reply_pairs(given).collect()}
    assert set(pairs) == {1, 3} and pairs[1]["rejected"][-1]["text"] == "x" * 100_000 and pairs[3]["rejected"][-1]["text"] == "b"


def test_bpe_equals_the_library(table):
    library, rng = Tokenizer.from_file(VOCABULARY), random.Random(4)
    parts = ["a", "e", "ing", "'s", " ", "\t", "\n", "1", "é", "é", "Σ", "İ", "中", "!?", "_", "\x1c", "\x85", "THE", "<|endoftext|>", "<|startoftext|", "😀", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["ab" * 2000, "a" * 500, "word " * 30_000, "", "The same", "The same"]
    given = table([*enumerate(texts), (None, None)], "doc_id long, text string")
    out = encode.encode(given, VOCABULARY, outputs=tuple(encode.OUTPUTS), keep_text=True).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_bpe_of_nothing_and_clashing_names(table):
    assert encode.encode(table([], "doc_id long, text string"), VOCABULARY).collect() == []
    out = encode.encode(table([(1, "a b", "x", 2)], "doc_id long, text string, _text string, ids int"), VOCABULARY)
    assert out.columns == ["doc_id", "_text", "n_tokens", "ids"] and out.first()["_text"] == "x" and len(out.first()["ids"]) == 2


def test_bpe_of_the_documents(spark, documents, sf_dir):
    library = Tokenizer.from_file(VOCABULARY)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in queries.QUERIES["op9_trie_bpe"](spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest() and r["n_tokens"] == len(ids)


def test_hidden_elements_without_end_hide_only_their_parent():
    texts = lambda page: [b[0] for b in html.text_blocks(page)]
    for name in ("button", "select", "object", "svg", "math", "canvas", "audio", "video", "iframe", "noscript", "template"):
        assert texts(f"<p>One</p><div><{name}>hidden <i>too</i> and this</div>Two<p>Three</p>") == ["One", "Two", "Three"]
        assert texts(f"<p>One <span><{name}>hidden<img>hidden</span> more<p>Two") == ["One more", "Two"]
        assert texts(f"<p>One <{name}>hidden</{name}>more<{name}/> text<p>Two") == ["One more text", "Two"]
    for name in ("script", "style", "textarea", "title"):
        assert texts(f"<p>One</p><{name}>hidden<p>hidden") == ["One"]
