"""Secrets in whole texts: known forms, and strings whose sliding-window entropy is that of random keys.

Known forms (base spans): assignments to secret-like names, access keys, long hexadecimal runs. Beyond these, every run of
WINDOW or more key characters that holds digits and letters is a candidate. A window of WINDOW characters moves over it;
its character counts are kept from step to step, the sum of c log2 c over them is updated by the one count that grows and the
one that shrinks, and gives the window's Shannon entropy. Candidates of letters alone are none: words are as even as keys. The limit depends on the candidate's character class: hexadecimal, letters of both cases
with digits, or of one case with digits. The stretch from the first to the last window within the limit is an `entropy`
span, unless the candidate is a UUID, the stretch holds a word of the allow-list, or it lies inside a base span. A listed
word in another part of a path or name allows nothing.

Positions count code points, ends are exclusive. All is one narrow pass of column expressions. c log2 c is held in whole
thousandths, so that sums are exact.

Null and empty texts have no spans. Repeated rows and null keys keep their rows; an empty table gives no rows. Very long
texts are one row as all others; work grows with their length. Columns other than the named ones are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 20
#: The forms of base spans, with the least length of the part that counts (group 2 of assign, else all).
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]
#: A run of key characters with a digit and a letter.
CANDIDATE = f"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a character that a window must reach, by character class.
BITS = {"hex": 3.0, "mixed": 3.7, "one_case": 3.4}
#: What looks random and is none: whole candidates in UUID form, and stretches that hold sample words, alphabets or digit rows.
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
ALLOWED = "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|abcdefgh|ABCDEFGH|01234567|12345678"
#: All characters of a candidate.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WEIGHTS = [0, *(round(1000 * c * math.log2(c)) for c in range(1, WINDOW + 1))]


def limit_of(bits: float) -> int:
    """The largest sum of weights of a window that still has so many bits a character."""
    return math.floor(1000 * WINDOW * (math.log2(WINDOW) - bits))


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Matches of the pattern as (s, e, kind, m), placed by the lengths of what lies between them."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint,k:int,m:string>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).cast("bigint").alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).cast("bigint").alias("s"), (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).cast("bigint").alias("e"), F.lit(KINDS.index(kind)).alias("k"), x["m"].alias("m")))).alias("out"),
    )
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast("array<struct<s:bigint,e:bigint,k:int,m:string>>")


def _limit(x: Column) -> Column:
    """Largest window sum by character class; null for strings without both digits and letters."""
    digit, lower, upper = x.rlike("[0-9]"), x.rlike("[a-z]"), x.rlike("[A-Z]")
    return (
        F.when(digit & x.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & (lower | upper), limit_of(BITS["hex"]))
        .when(digit & lower & upper, limit_of(BITS["mixed"]))
        .when(digit & (lower | upper), limit_of(BITS["one_case"]))
    )


def _random_stretch(x: Column, limit: Column) -> Column:
    """(first, last): where the windows within the limit begin and end; nulls if there are none.

    One pass over the characters, whatever the length: the counts of the current window ride along, one grows and one
    shrinks a step, and the sum follows from the two.
    """
    weight = lambda c: F.element_at(F.array(*map(F.lit, WEIGHTS)), c + 1)
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def over(cs: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            comes, goes = F.element_at(cs, j), F.when(j > WINDOW, F.get(cs, j - WINDOW - 1)).otherwise(0)
            grows, shrinks = F.get(acc["counts"], comes - 1), F.when(goes > 0, F.get(acc["counts"], goes - 1)).otherwise(0)
            # A character that comes as it goes leaves everything as it is.
            moved = F.when(comes == goes, 0).otherwise(weight(grows + 1) - weight(grows) + F.when(goes > 0, weight(shrinks - 1) - weight(shrinks)).otherwise(0))
            counts = F.when(comes == goes, acc["counts"]).otherwise(F.transform(acc["counts"], lambda n, i: n + F.when(i == comes - 1, 1).when(i == goes - 1, -1).otherwise(0)))
            total = acc["sum"] + moved
            within = (j >= WINDOW) & (total <= limit)
            return F.struct(
                counts.alias("counts"), total.cast("int").alias("sum"), F.coalesce(acc["first"], F.when(within, j - WINDOW)).alias("first"), F.when(within, j).otherwise(acc["last"]).alias("last")
            )

        nothing = F.lit(None).cast("int")
        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).alias("sum"), nothing.alias("first"), nothing.alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.size(cs)), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    # The array is bound to a variable, so that it is made once and not at every step.
    return F.element_at(F.transform(F.array(codes), over), 1)


def _allowed(stretch: Column) -> Column:
    """Whether a stretch holds a listed word, and no part between separators that is long enough without one."""
    parts = F.split(stretch, "[/=_-]")
    return stretch.rlike(ALLOWED) & ~F.exists(parts, lambda p: (F.length(p) >= WINDOW) & ~p.rlike(ALLOWED))


def find_secrets(docs: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """`keys`, `text` and `spans`: array of (s, e, k, m) by start and kind, k an index of KINDS and m the matched text."""
    d = docs.select(*keys, F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    t = F.col("text")
    assign = F.filter(_spans(t, ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    candidates = F.filter(_spans(t, CANDIDATE, "entropy"), lambda x: _limit(x["m"]).isNotNull() & ~x["m"].rlike(UUID))
    d = d.select(
        *keys,
        "text",
        F.when(t.rlike("[:=]") & t.rlike(ASSIGN), assign).otherwise(_none()).alias("_a"),
        F.when(t.contains("AKIA"), _spans(t, ACCESS, "access")).otherwise(_none()).alias("_k"),
        F.when(t.rlike(HEX), _spans(t, HEX, "hex")).otherwise(_none()).alias("_h"),
        F.when(t.rlike("[0-9]") & t.rlike(CANDIDATE), candidates).otherwise(_none()).alias("_c"),
    )
    d = d.withColumn("_base", F.concat("_a", "_k", "_h"))
    random = F.transform("_c", lambda x: F.struct(x.alias("x"), _random_stretch(x["m"], _limit(x["m"])).alias("r")))
    d = d.withColumn("_r", F.filter(random, lambda y: y["r"]["last"].isNotNull()))
    found = F.transform("_r", lambda y: F.struct((y["x"]["s"] + y["r"]["first"]).alias("s"), (y["x"]["s"] + y["r"]["last"]).alias("e"), y["x"]["k"].alias("k"), F.substring(y["x"]["m"], y["r"]["first"] + 1, y["r"]["last"] - y["r"]["first"]).alias("m")))
    own = F.filter(found, lambda y: ~_allowed(y["m"]) & ~F.exists("_base", lambda b: (b["s"] <= y["s"]) & (b["e"] >= y["e"])))
    return d.select(*keys, "text", F.array_sort(F.concat("_base", own)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(found: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` and the text with every span, overlapping ones together, replaced by its first kind in brackets."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["e"]).alias("at"),
        F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)), F.lit("]"))).otherwise(acc["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    tail = lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text")))
    return found.select(*keys, F.aggregate("spans", start, step, tail).alias("text"))
