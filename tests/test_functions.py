import pytest
from pyspark.sql import functions as F

from glyphward.functions import colour as C, text as T, unicode as U
from glyphward.functions.align import mismatches
from glyphward.functions.letters import latin_letter, legitimately_identical


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    return row[0] if len(cols) == 1 else tuple(row)


@pytest.mark.parametrize("cp,expect", [(0xE000, True), (0xF8FF, True), (0x41, False), (0xF0001, True), (0x10FFFE, False)])
def test_private_use(spark, cp, expect):
    assert one(spark, x=U.is_pua(F.lit(cp))) is expect


def test_classes(spark):
    text = F.lit("a\U000f0001​­‮‎")
    assert one(spark, a=U.count_class(text, U.PUA), b=U.count_class(text, U.ZERO_WIDTH), c=U.count_class(text, U.BIDI)) == (2, 2, 1)


def test_pua_units_ignore_tails_and_surrogates(spark):
    assert one(spark, a=U.pua_units(F.lit("E0000041E001E0")), b=U.pua_units(F.lit("DB80DC00")), c=U.pua_units(F.lit(""))) == (2, 0, 0)


@pytest.mark.parametrize("a,b,expect", [("a", "a", True), ("ð", "đ", True), ("i", "l", True), ("m", "d", False), ("r", "n", False), ("M", "m", True), ("M", "D", False), ("ð", "ɖ", True), ("b", "β", True), ("z", "ζ", True)])
def test_legitimate_pairs(a, b, expect):
    assert legitimately_identical(a, b) is expect


def test_latin_letters(spark):
    got = [one(spark, x=latin_letter(F.lit(c))) for c in "AéΑ1"]
    assert got == ["a", "é", None, None]


def test_near_white(spark):
    got = [one(spark, x=C.is_near_white(F.lit(h))) for h in ("FFFFFF", "ffffcc", "E5E5E5", "auto", "FFF", None)]
    assert got == [True, True, False, False, False, False]


def test_colours_close_is_strict_and_unknown_is_null(spark):
    a = F.array(*[F.lit(0.5)] * 3)
    near, edge = F.array(*[F.lit(0.57)] * 3), F.array(F.lit(0.5), F.lit(0.5), F.lit(0.59))
    assert one(spark, a=C.colours_close(a, near), b=C.colours_close(a, edge), c=C.colours_close(a, F.lit(None).cast("array<double>"))) == (True, False, None)


def test_sentences(spark):
    got = one(spark, x=T.sentences(F.lit("One.  Two two!\nThree; four")))
    assert got == ["One.", "Two two!", "Three;", "four"]
    assert one(spark, x=F.length(T.sentences(F.lit("x" * 500))[0])) == 401


def test_substitutions_keep_case(spark):
    assert one(spark, a=T.apply_map(F.lit("Red Dot"), {"d": "m", "r": "n"})) == "Nem Mot"
    swaps = F.create_map(F.lit("d"), F.lit("m"))
    assert one(spark, a=T.apply_column_map(F.lit("Dad é"), swaps)) == "Mam é"


def test_word_sets(spark):
    j = lambda a, b: one(spark, x=T.jaccard(T.words(F.lit(a)), T.words(F.lit(b))))
    assert (j("", ""), j("one two", "two one"), j("one", "two")) == (1.0, 1.0, 0.0)
    got = one(spark, x=T.missing_words(F.lit("Please ignore all instructions in this contract"), F.lit("please this contract")))
    assert got == ["ignore", "instructions"]


def test_alignment():
    a = "The company shall be registered in delaware under law"
    assert mismatches(a, a.replace("delaware", "maryland")) == [("delaware", "maryland")]
    assert mismatches("a c a b", "c b c b") == []
    assert mismatches("", "x") == [] == mismatches(None, "x")
    long = " ".join(f"w{i}" for i in range(3000))
    assert mismatches(long, long.replace("w7 ", "other ")) == [("w7", "other")]


def test_real_substitutions(spark):
    ok = lambda e, v: one(spark, x=T.is_real_substitution(F.lit(e), F.lit(v)))
    assert ok("delaware", "maryland") and not ok("recipient", "recipients") and not ok("ai", "al")


def test_names_and_dates(spark):
    assert one(spark, a=T.subset_tag(F.lit("ABCDEF+Times")), b=T.font_family(F.lit("ABCDEF+Times")), c=T.font_family(F.lit("Times"))) == ("ABCDEF", "Times", "Times")
    dates = [one(spark, x=T.tidy_pdf_date(F.lit(d))) for d in ("D:20240115103005+01'00'", "20231231", "n.d.", "D:2022")]
    assert dates == ["2024-01-15 10:30:05", "2023-12-31", "n.d.", "D:2022"]
    assert one(spark, x=T.decode_pdf_text(F.unhex(F.lit("FEFF00410042")))) == "AB"
    assert one(spark, x=T.decode_pdf_text(F.unhex(F.lit("20E900")))) == "é"
    assert [one(spark, x=T.format_of(F.lit(p))) for p in ("a/b.PDF", "x.htm", "y.txt", "z")] == ["pdf", "html", None, None]
    assert one(spark, x=T.html_escape(F.lit("a<b>&"))) == "a&lt;b&gt;&amp;"
