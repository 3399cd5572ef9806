"""Column expressions against small models in plain Python."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from wordloom.functions import text as T


def column(spark, expr, values, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema).select(expr).collect()]


WORDS = ["Nhà Đẹp", "café", " ÀÉÎÕÜ ", "đường", "Straße", "plain", "", "Ệ", "é", "naïve 12", "ĳ"]


def test_fold(spark):
    def model(s):
        s = unicodedata.normalize("NFD", s.lower().replace("đ", "d"))
        return "".join(c for c in s if not unicodedata.category(c).startswith("M")).strip()

    assert column(spark, T.fold("s"), WORDS) == [model(w) for w in WORDS]
    assert column(spark, T.fold_keep_d("s"), ["Đẹp"]) == ["đep"]
    assert column(spark, T.looks_vietnamese("s"), ["nhà", "nha", "Đ", "ß"]) == [True, False, True, False]


def model_osa(a, b):
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and (a[i - 1], a[i - 2]) == (b[j - 2], b[j - 1]):
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_osa(spark):
    rng = random.Random(1)
    pairs = [("recieve", "receive"), ("bnak", "bank"), ("ca", "abc"), ("", "ab"), ("ab", ""), ("", "")]
    pairs += [tuple("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [tuple(r) for r in df.select(T.osa("a", "b"), T.osa_within("a", "b", 2)).collect()]
    for (a, b), (whole, near) in zip(pairs, got):
        d = model_osa(a, b)
        assert whole == d and near == (d if d <= 2 else None), (a, b)


def test_edits1(spark):
    def model(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        out |= {a + c + b[1:] for a, b in cuts if b for c in T.LETTERS} | {a + c + b for a, b in cuts for c in T.LETTERS}
        return out - {w}

    for w, got in zip(("bnak", "a", ""), column(spark, T.edits1("s"), ["bnak", "a", ""])):
        assert set(got) == model(w) and len(got) == len(set(got))


def test_grams_and_hash(spark):
    assert column(spark, T.trigrams("s"), ["ab-cdab", "ab", ""]) == [["abc", "bcd", "cda", "dab"], [], []]
    assert column(spark, T.count_overlapping(F.col("s"), "aa"), ["aaaa", "b"]) == [3, 0]

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    words = ["bank", "nhà", "", "x y"]
    assert column(spark, T.fnv1a32("s"), words) == [fnv(w) for w in words] and fnv("bank") == 999632535


def test_ipa(spark):
    given = ["/ˈsɪt.i/ [ˈsɪɾ.i]", "/ˈloɪn/ ~ /ˈlɔɪn/", "/ˈkriˈeɪʃən/", "/ˈˈd͡ʒuːəl/", "/ɹʌn/", "", None, "/ˈsɔːriŋ ˈsɔər-/"]
    want = ["/ˈsɪt.i/", "/ˈloɪn/", "/ˌkriˈeɪʃən/", "/ˈd͡ʒuːəl/", "/rʌn/", "", None, "/ˈsɔːriŋ/"]
    assert column(spark, T.ipa_clean("s"), given) == want
    old = ["fju:", "brajbi:t", "'minit. mai'nju:t", "stjd", "@@", "", None, "trans'kʌltʃәrәl,trænz-", "mә:tʃәndaiz"]
    new = ["/fjuː/", "/braʊbiːt/", "/ˈminit/", "/stʊd/", None, None, None, "/transˈkʌltʃərəl/", "/mɜːtʃəndaiz/"]
    assert column(spark, T.old_phonetic_to_ipa("s"), old) == new


def test_terms_and_tags(spark):
    assert column(spark, T.vi_terms("s"), ["Bờ (sông, hồ...)", "ngân hàng; nhà băng, ngân hàng", "một lời giải thích rất dài", "a hoặc b", "x2"]) == [["bờ"], ["ngân hàng", "nhà băng"], [], ["a", "b"], []]
    tags = [(["transitive", "ditransitive", "formal", "New-Zealand"],), ([],)]
    assert column(spark, T.grammar_codes("t"), tags, "t array<string>") == ["[T]", ""]
    assert column(spark, T.usage_labels("t"), tags, "t array<string>") == ["formal, New Zealand", ""]
    assert column(spark, T.pos_name("s"), [" Adjective ", "verb", None]) == ["adj", "verb", ""]
    assert column(spark, T.first_label(F.col("t"), [(["past", "participle"], "pp"), (["past"], "past")]), [(["past"],), (["participle", "past"],), (["x"],)], "t array<string>") == ["past", "pp", None]


def test_queries_and_fields(spark):
    assert column(spark, T.clean_query("s"), ["  take   off! 12", "don't*?", "nhà"]) == ["take off", "don't*?", "nhà"]
    assert column(spark, T.shorten_query("s"), ["one two", "a b c d " * 20]) == ["one two", "a b c"]
    assert column(spark, T.csv_field("s"), ['a"b', "a,b", "a\nb", "ab", None]) == ['"a""b"', '"a,b"', '"a\nb"', "ab", ""]
    assert column(spark, T.version_less(F.col("a"), F.col("b")), [("1.2.3", "1.10.0"), ("2", "1.9"), ("1.0", "1.0.0")], "a string, b string") == [True, False, False]
    assert column(spark, T.json_inside("s"), ['say {"a": {"b": 1}} end', "none"]) == ['{"a": {"b": 1}}', None]
    assert column(spark, T.list_name("s"), ["  a \t b ", " ", "x" * 81]) == ["a b", None, None]
    assert column(spark, T.url_encode("s"), ["take off"]) == ["take%20off"]
    assert column(spark, T.word_boundary_hit(F.col("a"), F.col("b")), [("ngôi nhà to", "nhà"), ("nhàn", "nhà"), ("a.b", "."), ("xay", "a")], "a string, b string") == [True, False, False, False]
    assert column(spark, T.shared_text("s"), [" one \ntwo", "x" * 200]) == ["one", "x" * 100]
    assert column(spark, T.clean_etymology("s"), ["Etymology tree\n├ x\nFrom Latin.\n\nVia French.\nMore.", None]) == ["From Latin. Via French.", ""]
    assert column(spark, T.sentences("s"), ['One. Two! "Three" no. four']) == [["One.", "Two!", '"Three" no. four']]
    assert re.match(r"\d{8}-\d{6}$", column(spark, T.stamp(F.current_timestamp()), ["x"])[0])
