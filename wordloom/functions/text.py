"""Text as column expressions: everything here stays inside the JVM.

"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- folding (STR-01..06, STR-12, VAR-17) -------------------------------------------------------------------------

@lru_cache(None)
def fold_map() -> tuple[str, str]:
    """Letters with marks and their bases, and the marks themselves, which map to nothing.

    Built by rule: every letter up to U+024F, in U+0370-U+04FF and U+1E00-U+1FFF whose canonical decomposition is a base and marks.
    """
    pairs, marks = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x500), *range(0x1E00, 0x2000)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.category(c).startswith("M"))
        if plain != chr(code) and len(plain) == 1:
            pairs.append((chr(code), plain))
    for code in [*range(0x300, 0x370), *range(0x483, 0x48A), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100)]:
        marks.append(chr(code))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


@lru_cache(None)
def single_mark_map() -> tuple[str, str]:
    """Latin letters with just one mark, and their bases; built by rule from canonical decompositions."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        d = unicodedata.normalize("NFD", chr(code))
        if len(d) == 2 and unicodedata.category(d[1]).startswith("M") and ord(d[0]) < 0x250:
            pairs.append((chr(code), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: White space as Unicode defines it, for Java patterns (STR-30, VAR-30).
WHITE = r"\p{IsWhite_Space}"


def trim_white(c: Column | str) -> Column:
    """STR-30."""
    return F.regexp_replace(_c(c), rf"^{WHITE}+|{WHITE}+$", "")


def split_white(c: Column | str) -> Column:
    """VAR-30: words between white space, without empty ones."""
    return F.filter(F.split(_c(c), rf"{WHITE}+"), lambda x: x != "")


def strip_marks(c: Column | str) -> Column:
    """VAR-17: letters lose their marks and keep their case."""
    return F.translate(_c(c), *fold_map())


def fold(c: Column | str) -> Column:
    """STR-02..06: the one folding that lookups and tables share: lower case, đ as d, no marks, trimmed."""
    return trim_white(strip_marks(F.translate(F.lower(_c(c)), "đ", "d")))


def fold_single_marks(c: Column | str) -> Column:
    """STR-12: lower case, and letters with one mark lose it; those with two keep both."""
    return F.translate(F.lower(_c(c)), *single_mark_map())


def fold_keep_d(c: Column | str) -> Column:
    """STR-01: as fold, but đ stays."""
    return trim_white(strip_marks(F.lower(_c(c))))


def looks_vietnamese(c: Column | str) -> Column:
    """FLT-31: đ, or a letter that is a base and a mark."""
    c = _c(c)
    return c.rlike("[đĐ]") | (strip_marks(c) != c)


# --- words, sentences, n-grams ---------------------------------------------------------------------------------------

SENTENCE_END = "(?<=[.!?])\\s+(?=[A-Z\"“])"


def sentences(c: Column | str) -> Column:
    """STR-07."""
    return F.split(_c(c), SENTENCE_END)


def tokens(c: Column | str) -> Column:
    """STR-19: words of a-z and apostrophes."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z][a-z']*"), F.lit(0))


#: Words that say nothing about a sense.
GLOSS_STOP = "a an the of to in on or and for with by at as from that which who something someone one be is used etc".split()


def gloss_tokens(c: Column | str) -> Column:
    """STR-18: distinct words of three letters or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(GLOSS_STOP)))


def jaccard(a: Column, b: Column) -> Column:
    """JOIN-09: 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def trigrams(c: Column | str, letters_only: bool = True) -> Column:
    """STR-11: distinct runs of three letters, other characters left out."""
    s = F.regexp_replace(_c(c), r"[^\p{IsAlphabetic}]", "") if letters_only else _c(c)
    return F.array_distinct(grams(s, 3))


def grams(s: Column, n: int) -> Column:
    """All runs of n characters, repeats included (STR-13 counts one by filtering them)."""
    last = F.length(s) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def count_overlapping(s: Column, part: str) -> Column:
    """STR-13."""
    return F.size(F.filter(grams(s, len(part)), lambda x: x == part))


LETTERS = "abcdefghijklmnopqrstuvwxyz'-"


def edits1(c: Column | str) -> Column:
    """STR-10: every string at one deletion, swap, replacement or insertion, without the word itself."""
    w = _c(c)
    n = F.length(w)
    cut = lambda i: F.substring(w, F.lit(1), i)
    rest = lambda i: F.substring(w, i + 1, n)
    letters = F.array(*[F.lit(x) for x in LETTERS])
    places = F.sequence(F.lit(0), n)
    inner = F.filter(places, lambda i: i < n)
    delete = F.transform(inner, lambda i: F.concat(cut(i), rest(i + 1)))
    swap = F.transform(F.filter(places, lambda i: i < n - 1), lambda i: F.concat(cut(i), F.substring(w, i + 2, F.lit(1)), F.substring(w, i + 1, F.lit(1)), rest(i + 2)))
    replace = F.flatten(F.transform(inner, lambda i: F.transform(letters, lambda x: F.concat(cut(i), x, rest(i + 1)))))
    insert = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda x: F.concat(cut(i), x, rest(i)))))
    return F.filter(F.array_distinct(F.concat(delete, swap, replace, insert)), lambda x: x != w)


def osa(a: Column | str, b: Column | str) -> Column:
    """STR-08: edit distance in which swapping two neighbours is one edit; each part of a word is edited once.

    A dynamic programme over rows: the state holds the last two rows.
    """
    a, b = _c(a), _c(b)
    m = F.length(b)
    zero = F.transform(F.sequence(F.lit(0), m), lambda j: j)
    start = F.struct(zero.alias("up"), zero.alias("row"))

    def row(s: Column, i: Column) -> Column:
        here = F.substring(a, i, F.lit(1))

        def cell(acc: Column, j: Column) -> Column:
            there = F.substring(b, j, F.lit(1))
            best = F.least(F.element_at(acc, -1) + 1, F.element_at(s["row"], j + 1) + 1, F.element_at(s["row"], j) + F.when(here == there, 0).otherwise(1))
            swapped = (i > 1) & (j > 1) & (here == F.substring(b, j - 1, F.lit(1))) & (F.substring(a, i - 1, F.lit(1)) == there)
            best = F.when(swapped, F.least(best, F.element_at(s["up"], F.greatest(j - 1, F.lit(1))) + 1)).otherwise(best)
            return F.concat(acc, F.array(best))

        new = F.aggregate(F.filter(F.sequence(F.lit(0), m), lambda j: j > 0), F.array(i), cell)
        return F.struct(s["row"].alias("up"), new.alias("row"))

    steps = F.filter(F.sequence(F.lit(0), F.length(a)), lambda i: i > 0)
    return F.aggregate(steps, start, row, lambda s: F.element_at(s["row"], -1))


def swapped_once(a: Column, b: Column) -> Column:
    """Whether two words of one length differ by two neighbours alone, swapped."""
    here = lambda x, i: F.substring(x, i, F.lit(1))
    places = F.filter(F.sequence(F.lit(0), F.length(a)), lambda i: (i > 0) & (here(a, i) != here(b, i)))
    i, j = F.get(places, F.lit(0)), F.get(places, F.lit(1))
    return (F.length(a) == F.length(b)) & (F.size(places) == 2) & (j == i + 1) & (here(a, i) == here(b, j)) & (here(a, j) == here(b, i))


def osa_within(a: Column | str, b: Column | str, most: int = 2) -> Column:
    """STR-09, FLT-23: the distance, or null if it is over ``most``.

    A swap costs the plain distance two edits, so words whose plain distance is over twice the limit are out before the
    dynamic programme runs.  A pair beyond the limit itself needs a swap, which leaves the letters as they are: the other
    edits bring most - 1 letters at most on either side that the other lacks.  A plain distance of up to two is the distance, unless it is
    one swap.
    """
    a, b = _c(a), _c(b)
    plain = F.levenshtein(a, b, 2 * most)
    lacking = lambda x, y: F.size(F.array_except(F.split(x, ""), F.split(y, "")))
    near = (plain >= 0) & ((plain <= most) | ((lacking(a, b) < most) & (lacking(b, a) < most)))
    d = F.when(plain < 0, None).when(plain < 2, plain).when(plain == 2, F.when(swapped_once(a, b), 1).otherwise(2)).when(near, osa(a, b))
    return F.when(d <= most, d)


def osa_distances(a: list[str], b: list[str], run: int = 2048) -> np.ndarray:
    """STR-08 for many pairs at once in a task: a dynamic programme over the rows of all pairs of about one length."""
    out = np.zeros(len(a), np.int64)
    size = np.array([[len(x), len(y)] for x, y in zip(a, b)]).reshape(-1, 2)
    order = np.lexsort((size[:, 1], size[:, 0]))
    for k in range(0, len(order), run):
        some = order[k:k + run]
        n, m = size[some, 0], size[some, 1]
        x, y = (np.zeros((len(some), max(1, s.max())), np.uint32) for s in (n, m))
        for table, texts in ((x, a), (y, b)):
            for i, at in enumerate(some):
                table[i, :len(texts[at])] = np.frombuffer(texts[at].encode("utf-32-le", "surrogatepass"), "<u4")
        along = np.arange(y.shape[1] + 1)
        before, row = None, np.broadcast_to(along, (len(some), len(along))).copy()
        out[some[n == 0]] = m[n == 0]
        for i in range(int(n.max())):
            new = row + 1
            new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (x[:, i, None] != y))
            if i:
                swap = (x[:, i, None] == y[:, :-1]) & (x[:, i - 1, None] == y[:, 1:])
                new[:, 2:] = np.where(swap, np.minimum(new[:, 2:], before[:, :-2] + 1), new[:, 2:])
            before, row = row, np.minimum.accumulate(new - along, axis=1) + along
            done = np.flatnonzero(n == i + 1)
            out[some[done]] = row[done, m[done]]
    return out


# --- edit-distance keys (FLT-23, JOIN-15, STR-10) ---------------------------------------------------------------------

def without_one(c: Column) -> Column:
    """What is left of a string without any one of its characters."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.length(c)), lambda i: i > 0), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))


def _keys(side: str, size: Column, forms: Column) -> Column:
    return F.transform(forms, lambda x: F.xxhash64(F.lit(side), size, x))


def half_keys(word: Column | str) -> Column:
    """Hashes of a word's halves and of what is left of each without one character: length + 2 keys at most.

    Two edits leave one half with one at most, so the word and one within two edits of it share a key of ``half_probes``.
    """
    w = _c(word)
    n = F.length(w)
    h = F.ceil(n / 2).cast("int")
    forms = lambda x: F.array_distinct(F.concat(F.array(x), without_one(x)))
    return F.concat(_keys("a", h, forms(F.substring(w, F.lit(1), h))), _keys("b", n - h, forms(F.substring(w, h + 1, n))))


def half_probes(query: Column | str, most: int = 2) -> Column:
    """Hashes that a string's ends have in common with ``half_keys`` of every word within two edits, a swap being one: about ten a character.

    The half of a word of any length that may be as near comes from as many characters of the string, or one more or fewer; a swap across
    the middle is a replacement in either half.
    """
    q = _c(query)
    n = F.length(q)
    lengths = F.filter(F.sequence(F.lit(-most), F.lit(most)), lambda i: n + i > 0)

    def probes(side: str, size: Column) -> Column:
        end = (lambda k: F.substring(q, F.lit(1), k)) if side == "a" else (lambda k: F.when(k <= 0, "").otherwise(F.substring(q, F.greatest(n - k + 1, F.lit(1)), k)))
        own = end(size)
        swap = F.transform(F.filter(F.sequence(F.lit(0), F.length(own)), lambda i: (i > 0) & (i < F.length(own))), lambda i: F.concat(F.substring(own, F.lit(1), i - 1), F.substring(own, i + 1, F.lit(1)), F.substring(own, i, F.lit(1)), F.substring(own, i + 2, n)))
        shorter = F.when(size > 0, F.array(end(size - 1))).otherwise(F.array().cast("array<string>"))
        return _keys(side, size, F.concat(F.array(own), shorter, without_one(own), without_one(end(size + 1)), swap))

    half = lambda i: F.ceil((n + i) / 2).cast("int")
    sizes = lambda f: F.array_distinct(F.transform(lengths, f))
    return F.array_distinct(F.concat(F.flatten(F.transform(sizes(half), lambda k: probes("a", k))), F.flatten(F.transform(sizes(lambda i: n + i - half(i)), lambda k: probes("b", k)))))


# --- hashes and shards ------------------------------------------------------------------------------------------------

def fnv1a32(c: Column | str) -> Column:
    """MTH-04: over the UTF-8 bytes."""
    hexed = F.hex(F.encode(_c(c), "UTF-8"))
    bytes_ = F.filter(F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int")), lambda i: i > 0)
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(hexed, (2 * i - 1).cast("int"), F.lit(2)), 16, 10).cast("bigint")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(bytes_, F.lit(2166136261).cast("bigint"), step)


def shard(c: Column | str, n: int) -> Column:
    """MTH-05."""
    return F.pmod(fnv1a32(c), F.lit(n)).cast("int")


def batch_id(version: str, model: Column, words: Column) -> Column:
    """MTH-09."""
    return F.substring(F.sha1(F.concat_ws("|", F.lit(version), model, F.array_join(words, "|"))), 1, 14)


def uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on values alone: samples by it don't depend on order or partitions (SRT-10..12)."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[_c(c).cast("string") for c in columns]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


# --- dictionary text ------------------------------------------------------------------------------------------------------

def vi_terms(c: Column | str, most_words: int = 4) -> Column:
    """STR-17, SET-06: the short terms of a gloss, in order, each once."""
    text = F.regexp_replace(_c(c), r"\([^)]*\)|\[[^\]]*\]", " ")
    parts = F.split(text, "[;,/]| hoặc ")
    bare = F.transform(parts, lambda p: trim_white(F.regexp_replace(F.lower(F.regexp_replace(p, "[.…!?:\"“”'‘’\\-–~]+", " ")), rf"{WHITE}+", " ")))
    short = lambda t: (F.size(F.split(t, " ")) <= most_words) & t.rlike(r"^[\p{L}\p{M}]+( [\p{L}\p{M}]+)*$")
    return F.array_distinct(F.filter(bare, short))


def ipa_clean(c: Column | str) -> Column:
    """STR-14: one phonemic transcription, stress marks regular; an empty or null one stays as it is."""
    s = F.translate(_c(c), "ɹ':", "rˈː")
    s = F.split(F.split(s, r" \[").getItem(0), " ~ ").getItem(0)
    s = trim_white(F.split(s, rf"ˌ{WHITE}+").getItem(0))
    bar = F.when(s.startswith("/"), "/").otherwise("")
    inner = F.regexp_replace(s, "^/+|/+$", "")
    # A last word with a hyphen at an end is an unfinished reading; one word always stays.
    inner = F.regexp_replace(inner, r"(?: (?:-[^ ]*|[^ ]*-))+$", "")
    s = F.regexp_replace(F.concat(bar, inner, bar), "ˈ+", "ˈ")
    last = F.length(s) - F.locate("ˈ", F.reverse(s)) + 1
    many = F.length(s) - F.length(F.replace(s, F.lit("ˈ"), F.lit(""))) > 1
    even = F.concat(F.translate(F.substring(s, F.lit(1), last - 1), "ˈ", "ˌ"), F.substring(s, last, F.length(s)))
    return F.when((_c(c) == "") | _c(c).isNull(), _c(c)).when(many, even).otherwise(s)


#: Signs of an old phonetic alphabet and what they stand for; vowels; signs that a result may hold.
OLD_SIGNS, NEW_SIGNS = "әєεˊ':^g\xa0", "əɛɛˈˈːɡɡ "
VOWELS = "aeiouæɑɒɔəɛɜɪʊʌɚɝɐɵ"
IPA_SIGNS = "abdefhijklmnprstuvwxzæɑɒɔəɛɜɪʊʌŋθðʃʒɡɚɝɐɵˈˌː()\\- "


def old_phonetic_to_ipa(c: Column | str) -> Column:
    """STR-15, STR-16: the first reading in IPA between bars, null if a sign is left over or no vowel is there."""
    s = F.regexp_replace(trim_white(_c(c)), "^/+|/+$", "")
    s = F.split(trim_white(s), r"\s*[;；，]\s*|\.\s+").getItem(0)
    # A part after a comma that has a hyphen replaces something; it goes if no hyphen is before it.
    s = trim_white(F.regexp_replace(s, r"^([^,\-]*),[^,]*-.*$", "$1"))
    s = F.translate(F.regexp_replace(s, r"\\+", "ɜ"), OLD_SIGNS + "[]", NEW_SIGNS)
    s = F.replace(F.replace(s, F.lit("ʤ"), F.lit("dʒ")), F.lit("ʧ"), F.lit("tʃ"))
    s = F.translate(s, ",.", "ˌˌ")
    # j before a vowel, or before another j, is a consonant, else a vowel of its own.
    s = F.regexp_replace(s, rf"j(?![{VOWELS}j])", "ʊ")
    s = F.replace(F.replace(s, F.lit("əː"), F.lit("ɜː")), F.lit("ɒː"), F.lit("ɔː"))
    s = trim_white(F.regexp_replace(s, r"\s+", " "))
    return F.when(s.rlike(f"^[{IPA_SIGNS}]+$") & s.rlike(f"[{VOWELS}]"), F.concat(F.lit("/"), s, F.lit("/")))


def clean_etymology(c: Column | str) -> Column:
    """STR-20: the first two lines that aren't blank and aren't part of a tree."""
    lines = F.transform(F.split(F.coalesce(_c(c), F.lit("")), "\n"), trim_white)
    prose = F.filter(lines, lambda x: (x != "") & ~x.rlike("^(Etymology tree|[├└│].*)$"))
    return F.concat_ws(" ", F.slice(prose, 1, 2))


#: Parts of speech as sources name them.
POS_ALIASES = {
    "adjective": "adj", "adverb": "adv", "preposition": "prep", "conjunction": "conj", "pronoun": "pron", "interjection": "intj", "determiner": "det",
    "numeral": "num", "phrasal verb": "verb", "prepositional phrase": "prep_phrase",
}
#: Grammar codes of sense tags, and the tags that are shown as labels.
GRAMMAR = {
    "countable": "C", "uncountable": "U", "transitive": "T", "intransitive": "I", "plural": "pl.", "singular": "sing.", "ditransitive": "T",
    "ergative": "I, T", "usually-plural": "usually pl.", "attributive": "only before noun", "predicative": "not before noun",
}
LABELS = (
    "formal informal slang colloquial dated rare figuratively humorous derogatory offensive vulgar literary poetic British UK US Australia Canada "
    "Ireland Scotland India New-Zealand South-Africa Internet euphemistic nonstandard childish law medicine mathematics computing business sports "
    "music biology chemistry physics finance military nautical religion technical"
).split()
#: Guidewords with a typing error.
GUIDEWORD_FIXES = {"FINEY": "MONEY", "FREQENCY": "FREQUENCY"}


def recode(c: Column | str, table: dict[str, str]) -> Column:
    """A value's code, or the value itself (STR-21, STR-23, LNG-09, VAR-35)."""
    c = _c(c)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)


def pos_name(c: Column | str) -> Column:
    """STR-21."""
    return recode(trim_white(F.lower(F.coalesce(_c(c), F.lit("")))), POS_ALIASES)


def grammar_codes(tags: Column | str) -> Column:
    """STR-22: the codes in brackets, or an empty text."""
    codes = F.create_map(*[F.lit(x) for kv in GRAMMAR.items() for x in kv])
    found = F.array_distinct(F.filter(F.transform(_c(tags), lambda t: codes[t]), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, F.concat(F.lit("["), F.concat_ws(", ", found), F.lit("]"))).otherwise("")


def usage_labels(tags: Column | str) -> Column:
    """STR-22."""
    return F.concat_ws(", ", F.transform(F.filter(_c(tags), lambda t: t.isin(LABELS)), lambda t: F.translate(t, "-", " ")))


# --- queries typed by people ---------------------------------------------------------------------------------------------

def clean_query(c: Column | str, marks: bool = False) -> Column:
    """FLT-29, STR-39: letters, ' - ? * . and single spaces; ``marks`` keeps combining marks."""
    keep = r"\p{IsAlphabetic}" + (r"\p{M}" if marks else "")
    return trim_white(F.regexp_replace(F.regexp_replace(_c(c), rf"[^{keep}'\-?*.{WHITE}]", " "), rf"{WHITE}+", " "))


def shorten_query(c: Column | str, longest: int = 60) -> Column:
    """FLT-30: three words of a query that is long or holds a sentence."""
    c = _c(c)
    return F.when((F.length(c) > longest) | c.rlike(r"[.!?]\s"), F.array_join(F.slice(split_white(c), 1, 3), " ")).otherwise(c)


def shared_text(c: Column | str) -> Column:
    """VAR-49: the first line, trimmed, 100 code points at most."""
    return F.substring(trim_white(F.split(trim_white(c), "\n").getItem(0)), 1, 100)


# --- presentation ---------------------------------------------------------------------------------------------------------

def escape_html(c: Column | str) -> Column:
    """STR-29."""
    c = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_markdown(c: Column | str) -> Column:
    """STR-40."""
    return F.regexp_replace(_c(c), r"([|*_`])", r"\\$1")


def highlighted(text: Column, start: Column, end: Column) -> Column:
    """STR-24: before, hit and after, by code points."""
    return F.struct(F.substring(text, F.lit(1), start).alias("before"), F.substring(text, start + 1, end - start).alias("hit"), F.substring(text, end + 1, F.length(text)).alias("after"))


def cloze(text: Column, start: Column, end: Column, gap: str = "______") -> Column:
    """STR-25."""
    return F.overlay(text, F.lit(gap), start + 1, end - start)


def bold(text: Column, start: Column, end: Column) -> Column:
    """VAR-48."""
    h = highlighted(text, start, end)
    return F.concat(h["before"], F.lit("**"), h["hit"], F.lit("**"), h["after"])


def mark_forms(text: Column, forms: Column) -> Column:
    """STR-26: the words of a text, each with a flag whether it is one of the forms (in lower case)."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}[\p{L}\p{M}'’-]*"), F.lit(0))
    return F.transform(words, lambda w: F.struct(w.alias("word"), F.array_contains(forms, F.lower(w)).alias("hit")))


def first_label(tags: Column, rules: list[tuple[list[str], str]]) -> Column:
    """STR-27, STR-28: the label of the first rule whose tags are all there; null if none is."""
    out = F.lit(None).cast("string")
    for need, label in reversed(rules):
        out = F.when(F.size(F.array_except(F.array(*[F.lit(x) for x in need]), tags)) == 0, F.lit(label)).otherwise(out)
    return out


def csv_field(c: Column | str) -> Column:
    """SNK-19."""
    c = F.coalesce(_c(c).cast("string"), F.lit(""))
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def safe_file_name(c: Column | str) -> Column:
    """STR-33, VAR-45."""
    return F.regexp_replace(_c(c), r"[^\p{L}\p{N} _\-]", "_")


def list_name(c: Column | str, longest: int = 80) -> Column:
    """STR-34: single spaces; null if nothing is left or too much is."""
    s = trim_white(F.regexp_replace(_c(c), rf"{WHITE}+", " "))
    return F.when((s != "") & (F.length(s) <= longest), s)


def version_less(a: Column | str, b: Column | str) -> Column:
    """STR-37: a.b.c compared number by number; a missing number is 0."""
    parts = lambda c: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.try_to_number(F.get(F.split(_c(c), r"\."), i), F.lit("999999")).cast("int"), F.lit(0)))
    return parts(a) < parts(b)


def json_inside(c: Column | str) -> Column:
    """STR-36: from the first brace to the last, null if there are none."""
    return F.nullif(F.regexp_extract(_c(c), r"(?s)\{.*\}", 0), F.lit(""))


def url_encode(c: Column | str) -> Column:
    """STR-31; Spark's url_encode writes a space as +, an address's fragment wants %20."""
    return F.replace(F.url_encode(_c(c)), F.lit("+"), F.lit("%20"))


def empty_to_null(c: Column | str) -> Column:
    """VAR-18, VAR-19."""
    return F.nullif(_c(c), F.lit(""))


# --- sentence predicates -----------------------------------------------------------------------------------------------------

#: Fixed patterns: signs of text that isn't prose, and personal data.
BAD_CHARS = r"[()\[\]{}|=<>@#/\\_*~^]|https?:|www\."
PERSONAL = r"\S+@\S+|\+?\d[\d\s().-]{7,}\d"


def spaced_words(c: Column | str) -> Column:
    """T8: a text's words are its spaces and one."""
    c = _c(c)
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def plausible_sentence(c: Column | str) -> Column:
    """FLT-01."""
    c = _c(c)
    return spaced_words(c).between(5, 40) & F.substring(c, 1, 1).rlike(r"^\p{Lu}") & F.substring(c, -1, 1).isin(".", "!", "?", '"', "”")


def has_odd_characters(c: Column | str) -> Column:
    """FLT-04."""
    c = _c(c)
    return c.rlike(BAD_CHARS) | ((F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))) % 2 != 0)


def has_personal_data(c: Column | str) -> Column:
    """FLT-05."""
    return _c(c).rlike(PERSONAL) | (F.regexp_count(_c(c), F.lit("[0-9]")) > 4)


def length_bucket(n: Column | str) -> Column:
    """FLT-19."""
    n = _c(n)
    return F.when(n <= 12, "short").when(n <= 20, "mid").otherwise("long")


def usable_highlight(text: Column, start: Column, end: Column) -> Column:
    """FLT-15, STR-38: no capital inside a sentence, no hyphen beside, few capitalised words."""
    at = F.substring(text, start + 1, F.lit(1))
    words = F.filter(split_white(text), lambda w: w.rlike(r"^\p{L}"))
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    # substring() reads from the end for a start of 0 or less, so a hit at the very begin is told apart.
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    return ~((start > 0) & at.rlike(r"^\p{Lu}")) & (before != "-") & (F.substring(text, end + 1, F.lit(1)) != "-") & (capital <= 0.4 * F.size(words))


def word_boundary_hit(text: Column, word: Column) -> Column:
    """FLT-21, FLT-22: the word occurs with no letter right before or after it.

    The word is quoted, so its own signs mean themselves.
    """
    quoted = F.concat(F.lit(r"(?<!\p{L})\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\p{L})"))
    return F.regexp_like(text, quoted)


def now_seconds() -> Column:
    """MTH-06: seconds since 1970, the same for all rows of a query."""
    return F.unix_seconds(F.current_timestamp())


def stamp(ts: Column | str) -> Column:
    """MTH-08."""
    return F.date_format(_c(ts), "yyyyMMdd-HHmmss")
