"""English (Porter2 / Snowball) stemmer, from its published description, as column expressions.

Every step is a projection over the rows of words given, so a step's result is computed once and the whole chain
stays in generated code. Run it on distinct words, as ``quillrank.operators.analysis`` does per document.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_FINAL_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_R1_PREFIXES = ["gener", "commun", "arsen"]
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
]
_STEP4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion", "al", "er", "ic",
]


_VOWEL = "[aeiouy]"
_REGION = "^.*?[aeiouy][^aeiouy]"
_SHORT_END = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
_DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
_LI_BEFORE = "cdeghkmnrt"


def with_stem(rows: DataFrame, word: str, into: str) -> DataFrame:
    """``rows`` with the stem of column ``word``; null stays null. Columns ``_w`` to ``_done`` must not be there."""
    steps, stem = _steps(word, rows.sparkSession.sparkContext.applicationId)
    for name, value in steps:
        rows = rows.withColumn(name, value)
    return rows.withColumn(into, stem).drop("_w", "_r1", "_r2", "_suffix", "_base", *(["_done"] if into != "_done" else []))


@lru_cache(maxsize=8)
def _steps(word: str, application: str) -> tuple[list[tuple[str, Column]], Column]:
    """The columns to add one after the other, and the stem at their end.

    Making so many expressions takes the driver a second; they name columns only, so an application makes them once.
    """
    steps: list[tuple[str, Column]] = []
    w, base, suffix = F.col("_w"), F.col("_base"), F.col("_suffix")
    n, r1, r2 = F.length("_w"), F.col("_r1"), F.col("_r2")

    def region(text: Column, found: Column) -> Column:
        return F.when(found != "", F.length(found)).otherwise(F.length(text))

    def add(name: str, value: Column) -> None:
        steps.append((name, value))

    def cut(endings: list[str]) -> None:
        # Of all endings that fit, the match that starts first is the longest.
        add("_suffix", F.regexp_extract("_w", f"({'|'.join(endings)})$", 1))
        add("_base", F.substring(w, F.lit(1), n - F.length(suffix)))

    def replaced(pairs: list[tuple[str, str]]) -> Column:
        value = F.lit("")
        for ending, to in pairs:
            value = F.when(suffix == ending, F.lit(to)).otherwise(value)
        return F.concat(base, value)

    special = F.lit(None).cast("string")
    for name, stem in _SPECIAL.items():
        special = F.when(F.col(word) == name, F.lit(stem)).otherwise(special)
    add("_done", F.when(F.length(word) <= 2, F.col(word)).otherwise(special))
    # A y at the start or after a vowel acts as a consonant and is marked by a capital.
    add("_w", F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y"), "([aeiouy])y", "$1Y"))
    first = F.regexp_extract(w, f"^({'|'.join(_R1_PREFIXES)})|{_REGION}", 0)
    add("_r1", region(w, first))
    rest = F.substring(w, r1 + 1, n)
    add("_r2", r1 + region(rest, F.regexp_extract(rest, _REGION, 0)))
    add("_w", F.regexp_replace("_w", "('s'|'s|')$", ""))

    # Step 1a.
    plural = (
        F.when(w.endswith("sses"), F.substring(w, F.lit(1), n - 2))
        .when(w.rlike("ie[ds]$"), F.substring(w, F.lit(1), n - F.when(n > 4, 2).otherwise(1)))
        .when(w.rlike("(us|ss)$"), w)
        .when(w.rlike(f"{_VOWEL}.+s$"), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )
    add("_w", plural)
    add("_done", F.coalesce("_done", F.when(w.isin(*sorted(_FINAL_AFTER_1A)), w)))

    # Step 1b.
    cut(["eedly", "ingly", "edly", "eed", "ing", "ed"])
    past = (
        F.when(suffix == "", w)
        .when(suffix.startswith("ee"), F.when(F.length(base) >= r1, F.concat(base, F.lit("ee"))).otherwise(w))
        .when(~base.rlike(_VOWEL), w)
        .when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e")))
        .when(base.rlike(_DOUBLE), F.substring(base, F.lit(1), F.length(base) - 1))
        .when((F.length(base) <= r1) & base.rlike(_SHORT_END), F.concat(base, F.lit("e")))
        .otherwise(base)
    )
    add("_w", past)
    # Step 1c.
    add("_w", F.regexp_replace("_w", "(?<=.[^aeiouy])[yY]$", "i"))

    # Steps 2, 3 and 4.
    cut([ending for ending, _ in _STEP2])
    before = F.when(suffix == "ogi", base.endswith("l")).when(suffix == "li", base.rlike(f"[{_LI_BEFORE}]$")).otherwise(F.lit(True))
    add("_w", F.when((suffix != "") & (F.length(base) >= r1) & before, replaced(_STEP2)).otherwise(w))
    cut([ending for ending, _ in _STEP3])
    start = F.when(suffix == "ative", r2).otherwise(r1)
    add("_w", F.when((suffix != "") & (F.length(base) >= start), replaced(_STEP3)).otherwise(w))
    cut(_STEP4)
    before = (suffix != "ion") | base.rlike("[st]$")
    add("_w", F.when((suffix != "") & (F.length(base) >= r2) & before, base).otherwise(w))

    # Step 5.
    shorter = F.substring(w, F.lit(1), n - 1)
    drop_e = w.endswith("e") & ((n - 1 >= r2) | ((n - 1 >= r1) & ~shorter.rlike(_SHORT_END)))
    drop_l = w.endswith("ll") & (n - 1 >= r2)
    add("_w", F.when(drop_e | drop_l, shorter).otherwise(w))
    stem = F.coalesce("_done", F.replace(w, F.lit("Y"), F.lit("y")))
    return steps, stem
