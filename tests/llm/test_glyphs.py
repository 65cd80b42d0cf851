import unicodedata as ud

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import glyphs as G

T = G.transducer()


def slow(text):
    """The same in several passes over the whole text."""
    kept, i = [], 0
    while i < len(text):
        if text[i] not in T.widthless:
            kept.append(text[i])
            i += 1
            continue
        end = i
        while end < len(text) and text[end] in T.widthless:
            end += 1
        run, before, after = text[i:end], text[i - 1 : i], text[end : end + 1]
        tags = len(run) - len(run.lstrip("".join(map(chr, range(0xE0020, 0xE0080)))))
        if before == "\U0001f3f4":
            kept.append(run[:tags])
            run, before = run[tags:], before if not tags else ""
        if before and after and "\u200d" in run and G.is_pictograph(before) and G.is_pictograph(after):
            kept.append("\u200d")
        i = end
    text = "".join(kept).replace("\r\n", "\n")
    out = []
    for c in text:
        wide = ud.decomposition(c)
        if wide.startswith(("<wide>", "<narrow>")) and not G.is_blank(c):
            c = "".join(chr(int(x, 16)) for x in wide.split()[1:])
        out.append("\n" if c in G.LINE_BREAKS else " " if G.is_blank(c) else c)
    return ud.normalize("NFC", "".join(T.letters.get(c, c) for c in ud.normalize("NFD", "".join(out))))


SIGNS = st.one_of(st.sampled_from("\U0001f468\u200d\U0001f469\U0001f3f4\U000e0067\U000e007f\u202e\ufe0f\u0301"), st.characters(exclude_categories=["Cn", "Co", "Cs"]), st.sampled_from([*T.base, *T.widthless]), st.sampled_from("aе́̈\r\n\t 가ᅡᆨｶﾞ゙ ​"))


@settings(max_examples=400, deadline=None)
@given(st.lists(SIGNS, max_size=12).map("".join))
def test_one_pass_equals_several_and_changes_nothing_again(text):
    once = T.apply(text)
    assert once == slow(text)
    assert T.apply(once) == once


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ＵＳＤ　１", "USD 1"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("a b c", "a b c"), ("раусhecк".replace("к", "k"), "paycheck"),
        ("ＥＵR", "ЕUR"), ("ｶﾞ", "ガ"), ("각", "각"), ("ё", "ë"), ("a\r\nb", "a\nb"), ("a b", "a\nb"), ("e͏́", "é"), ("ạ̈", "ạ̈"),
        ("ΟΧΙ", "OXI"), ("a­b", "ab"), ("‎a﻿", "a"), ("Å", "Å"), ("о́", "ό"),
    ],
)
def test_the_same(a, b):
    assert T.apply(a) == T.apply(b)


@pytest.mark.parametrize(
    ("a", "b"), [("a", "A"), ("e", "é"), ("x2", "x²"), ("2", "②"), ("No", "№"), ("a  b", "a b"), ("a\nb", "a b"), ("a\n\nb", "a\nb"), ("l", "I"), ("0", "O"), ("ν", "v"), ("к", "k"), ("ß", "ss"), ("ﬁ", "fi"), ("…", "..."), ("ı", "i"), ("ł", "l"), (" a", "a")]
)
def test_not_the_same(a, b):
    assert T.apply(a) != T.apply(b)


@pytest.mark.parametrize(
    ("a", "b"),
    [("pay \u202eabc", "pay abc"), ("\U0001f468\u200d\U0001f469", "\U0001f468\U0001f469"), ("\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U0001f3f4"), ("\U0001d400", "A")],
)
def test_signs_without_width_that_are_seen(a, b):
    assert T.apply(a) != T.apply(b) and T.apply(a) == a


@pytest.mark.parametrize(("a", "b"), [("ӏ", "l"), ("ρ", "p"), ("օ", "o"), ("Ꭺ", "A"), ("∶", ":"), ("Ð", "Đ"), ("ә", "ə"), ("\U0001f468\u200b\u200d\u2060\U0001f469", "\U0001f468\u200d\U0001f469"), ("ꓐ", "В")])
def test_further_look_alikes(a, b):
    assert T.apply(a) == T.apply(b)


def test_copies_are_spread_in_parts(spark):
    rows = list(enumerate(["hot"] * 30 + ["һot"] * 20 + ["hоt"] * 5))
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)
    got = [tuple(r) for r in G.look_alike_pairs(df).collect()]
    assert len(got) == len(set(got)) == 30 * 20 + 30 * 5 + 20 * 5 and set(got) == pairs_of(rows)


def test_the_form_is_made_once(spark, tmp_path):
    spark.createDataFrame([(1, "é", None, None)], DOCS).write.parquet(f"{tmp_path}/d")
    plan = G.look_alike_pairs(spark.read.parquet(f"{tmp_path}/d"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # what is joined and filtered has been put down


def test_null_empty_and_very_long():
    assert T.apply(None) is None and T.apply("") == "" and T.apply("​⁠") == ""
    assert T.apply("aé" * 500_000) == "aé" * 500_000
    assert T.apply("a" + "́" * 50_000) == ud.normalize("NFC", "a" + "́" * 50_000)


@pytest.mark.parametrize("pairs", [[("ab", "c")], [("aа", "bc"), ("а", "d")], [("а", "b"), ("b", "c")]])
def test_conflicts_are_found(pairs):
    with pytest.raises(ValueError):
        G.Transducer(pairs)


def pairs_of(rows):
    return {(min(i, j), max(i, j)) for i, a in rows for j, b in rows if i < j and a is not None and b is not None and a != b and slow(a) == slow(b) and slow(a).strip(" \n")}


DOCS = "doc_id bigint, text string, form string, stored string"


def test_pairs_with_copies_blanks_nulls(spark):
    texts = ["hot"] * 60 + ["һot", "ｈot", "hоt", "Hot", None, None, "", " ", " ", "​", "\n", "é", "é", "e", "y" * 50_000, "у" * 50_000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)
    got = [tuple(r) for r in G.look_alike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(rows)


def test_no_documents(spark):
    assert G.look_alike_pairs(spark.createDataFrame([], DOCS)).collect() == []


def test_pairs_of_test_data(spark, folder):
    from vigil.llm.queries import QUERIES
    from vigil.sources.tables import table

    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert {tuple(r) for r in QUERIES["p8_found"](spark, folder).collect()} == pairs_of(rows)
    forms = {r["doc_id"]: r["text"] for r in QUERIES["p8_texts"](spark, folder).collect()}
    assert forms == {i: None if t is None else slow(t) for i, t in rows}
