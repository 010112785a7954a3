"""English word stems as a column expression: the published suffix-stripping algorithm of 1980, one step after the other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the algorithm: (suffix, replacement) of its steps, longer suffixes first where one ends in another.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
LONG = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
MIDDLE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: Column) -> Column:
    """V for each vowel, C for each consonant; y is a vowel after a consonant."""
    vowels = F.translate(word, "aeiou", "VVVVV")
    # from the left: a y after a consonant is a vowel, and the next y stands after a vowel
    ys = F.regexp_replace(F.regexp_replace(vowels, "([^Vy])y", "$1V"), "(^|V)yy", "$1yV")
    return F.regexp_replace(ys, "[^V]", "C")


def measure(stem: Column) -> Column:
    """How many times consonants follow vowels."""
    return F.regexp_count(shape(stem), F.lit("V+C+"))


def _has_vowel(stem: Column) -> Column:
    return F.contains(shape(stem), F.lit("V"))


def _short_end(stem: Column) -> Column:
    """Consonant, vowel, consonant, the last one no w, x or y."""
    return shape(stem).rlike("CVC$") & ~stem.rlike("[wxy]$")


def _stem_of(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _step(word: Column, rules, fits) -> Column:
    """The first rule whose suffix the word has decides; fits(stem, suffix) tells whether it is replaced."""
    out = None
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        stem = _stem_of(word, suffix)
        now = F.when(fits(stem, suffix), F.concat(stem, F.lit(new))).otherwise(word)
        out = F.when(word.endswith(suffix), now) if out is None else out.when(word.endswith(suffix), now)
    return out.otherwise(word)


def _past(word: Column) -> Column:
    def mend(stem: Column) -> Column:
        doubled = stem.rlike("([^aeiou])\\1$") & ~stem.rlike("[lsz]$")
        return (F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(doubled, _stem_of(stem, "x"))
                .when((measure(stem) == 1) & _short_end(stem), F.concat(stem, F.lit("e"))).otherwise(stem))

    ed, ing, eed = _stem_of(word, "ed"), _stem_of(word, "ing"), _stem_of(word, "eed")
    return (F.when(word.endswith("eed"), F.when(measure(eed) > 0, F.concat(eed, F.lit("ee"))).otherwise(word))
            .when(word.endswith("ed"), F.when(_has_vowel(ed), mend(ed)).otherwise(word)).when(word.endswith("ing"), F.when(_has_vowel(ing), mend(ing)).otherwise(word)).otherwise(word))


def _final_e(word: Column) -> Column:
    stem = _stem_of(word, "e")
    return F.when(word.endswith("e") & ((measure(stem) > 1) | ((measure(stem) == 1) & ~_short_end(stem))), stem).otherwise(word)


def _on_stem(step):
    return lambda p: p.withField("stem", step(p["stem"]))


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words; words of one or two letters, and what has other characters than a-z, stay."""
    some = lambda stem, _: measure(stem) > 0
    more = lambda stem, suffix: (measure(stem) > 1) & (stem.rlike("[st]$") if suffix == "ion" else F.lit(True))
    pairs = F.transform(words, lambda w: F.struct(w.alias("word"), w.alias("stem")))
    for step in (
        lambda w: _step(w, PLURALS, lambda stem, suffix: F.lit(True)), _past,
        lambda w: F.when(w.endswith("y") & _has_vowel(_stem_of(w, "y")), F.concat(_stem_of(w, "y"), F.lit("i"))).otherwise(w),
        lambda w: _step(w, LONG, some), lambda w: _step(w, MIDDLE, some), lambda w: _step(w, [(s, "") for s in LAST], more), _final_e,
        lambda w: F.when(w.endswith("ll") & (measure(w) > 1), _stem_of(w, "l")).otherwise(w),
    ):
        pairs = F.transform(pairs, _on_stem(step))  # a transform each: what it starts from is computed once
    return F.transform(pairs, lambda p: F.when((F.length(p["word"]) > 2) & p["word"].rlike("^[a-z]+$"), p["stem"]).otherwise(p["word"]))
