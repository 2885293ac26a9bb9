"""Numbers, citations and reference lists checked as tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.small import MAX_ROWS, take_bounded
from ..sources.scratch import materialise

# The flags and tiers of the audit.
UNRESOLVED = "NOT-IN-CROSSREF"
AUTHOR_MISMATCH = "AUTHOR-MISMATCH"
VOLUME_MISMATCH = "VOLUME-MISMATCH"
DUPLICATE_TITLE = "DUPLICATE-TITLE"
DUPLICATE_SLOT = "DUPLICATE-COORDINATES"
DUPLICATED_BY_OTHER = "DUPLICATED-BY-OTHER"
UNCITED = "UNCITED"
CONFIRMED = "A. confirmed correct"
UNDECIDED = "B. needs manual resolution"
SUSPECT = "C. probable fabrication"

def number_tokens(df: DataFrame, column: str, keep: Sequence[str], comments: bool = True) -> DataFrame:
    """(keep, line, pos, token): every number of a text with its place.

    Texts without a digit cannot hold a number and skip the patterns.
    """
    df = df.where(F.col(column).rlike("[0-9]"))
    lines = F.split(tx.strip_noise(F.col(column), comments), "\n")
    each = df.select(*keep, F.posexplode(lines).alias("line", "_text"))
    found = F.regexp_extract_all("_text", F.lit(tx.NUMBER), F.lit(0))
    return each.select(*keep, (F.col("line") + 1).alias("line"), F.posexplode(found).alias("pos", "token"))


_FORM = r"^\s*([-+]?)([0-9]*)\.?([0-9]*)(?:e([-+]?[0-9]{1,18}))?\s*$"
_ZERO = r"^\s*[-+]?(0+\.?0*|\.0+)(e[-+]?[0-9]{1,18})?\s*$"


def _number(sign: Column, digits: Column, exp: Column) -> Column:
    """Sign * 0.digits * 10^exp as a struct that equal numbers share; digits have no zero at either end."""
    zero = digits == ""
    return F.struct(
        F.when(zero, 0).otherwise(sign).cast("int").alias("sign"),
        F.when(zero, 0).otherwise(exp).cast("long").alias("exp"), digits.alias("digits"),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often and under whatever condition it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact_number(token: Column) -> Column:
    """The exact value of a decimal token of any length, as (sign, exp, digits); null where it is no number.

    Exponents of more than 18 digits are no numbers.
    """
    def whole(part: Column) -> Column:
        every = F.concat(part[1], part[2])
        return _once(F.struct(F.length(every).alias("n"), F.ltrim(every, F.lit("0")).alias("left")), lambda x: F.when(x["n"] > 0, _number(
            F.when(part[0] == "-", -1).otherwise(1), F.rtrim(x["left"], F.lit("0")),
            F.length(part[1]) + F.coalesce(part[3].try_cast("long"), F.lit(0)) - (x["n"] - F.length(x["left"])))))

    low = F.lower(token)
    parts = F.when(low.rlike(_FORM), F.split(F.regexp_replace(low, _FORM, "$1,$2,$3,$4"), ","))
    return _once(parts, whole)


def decimal_number(token: Column, precision: int = 36, scale: int = 16) -> Column:
    """The value of a decimal token as a SQL ``DECIMAL(precision, scale)`` holds it, in the form of :func:`exact_number`.

    Rounded half up to ``scale`` decimals, so a number too small for them is zero. Null where the number does not fit and
    where its exponent does not fit 16 bits, for zeros too. A zero with a smaller exponent is zero.
    """
    plain = F.regexp_replace(F.lower(token), "e([-+]?)0+(?=[0-9])", "e$1")
    exponent = F.coalesce(F.regexp_extract(plain, "e(.*)", 1).try_cast("long"), F.lit(0))
    held = F.when(plain.rlike(_ZERO), F.lit("0")).otherwise(plain.try_cast(f"decimal({precision},{scale})").cast("string"))
    return exact_number(F.when(exponent.between(-(2**15), 2**15 - 1), held))


def _rounded(c: Column, places: Column) -> Column:
    """``c`` rounded to ``places`` decimals, as a number; null where it lies half way.

    For places from -exp to exp's last digit but one: what is cut off is not empty.
    """
    sign, exp, digits = (c.getField(f) for f in ("sign", "exp", "digits"))
    keep = (exp + places).cast("int")
    head, tail = F.substring(digits, F.lit(1), keep), F.substring(digits, keep + 1, F.length(digits))
    base = F.rtrim(head, F.lit("9"))
    up = F.concat(F.substring(base, F.lit(1), F.length(base) - 1), (F.right(base, F.lit(1)).try_cast("int") + 1).cast("string"))
    raised = F.when(base == "", _number(sign, F.lit("1"), exp + 1)).otherwise(_number(sign, up, exp))
    return F.when(tail < "5", _number(sign, F.rtrim(head, F.lit("0")), exp)).when(tail > "5", raised)


def rounded_results(vals: DataFrame, distinct: DataFrame, max_places: int = MAX_ROWS) -> DataFrame | None:
    """(_v, _p): each result ``_c`` rounded to places inside its own digits; None where no token has places.

    Only places that some token of ``distinct`` has are worked out, up to ``max_places`` different ones; beyond
    that, all between the least and the largest.
    """
    used = distinct.select("_p").where("_p IS NOT NULL").distinct()
    few = take_bounded(used, max_places)
    ends = used.agg(F.min("_p").alias("lo"), F.max("_p").alias("hi")).first() if few is None else None
    if few == []:
        return None
    least, largest = (ends["lo"], ends["hi"]) if few is None else (min(r[0] for r in few), max(r[0] for r in few))
    first = -F.col("_c.exp")
    lo, hi = F.greatest(first, F.lit(least)), F.least(first + F.length("_c.digits") - 1, F.lit(largest))
    places = F.sequence(lo, hi)
    if few is not None:
        wanted = [r[0] for r in few]
        places = F.filter(places, lambda p: p.isin(wanted))
    spread = vals.where(lo <= hi).select("_c", F.explode(places).alias("_p"))
    return spread.select(_rounded(F.col("_c"), F.col("_p")).alias("_v"), "_p").where("_v IS NOT NULL AND _v.sign <> 0")


def trace_numbers(tokens: DataFrame, values: DataFrame, token: str = "token", value: str = "value", number: Callable[[Column], Column] = exact_number) -> DataFrame:
    """Adds ``traced``: the number equals a result, or a result rounds to it.

    A number with p decimals is matched by results less than half a unit of its last
    place away. That is at most one rounded value per result and p, so the range join
    is an equi-join on (p, rounded result). Values are digit strings with an exponent:
    exact at any size, unless ``number`` reads them otherwise. A result fans out over those places inside its own digits that
    tokens have; with more places it is the result itself, with fewer it is zero, which
    the widest such place of all results settles. Tokens and results meet as distinct
    values only. Tokens and results are written once with their values, so their sources
    are read and their numbers are parsed once. Null tokens and tokens that are no numbers are not traced.
    """
    columns = tokens.columns
    t = materialise(tokens.withColumn("_v", number(F.col(token))).withColumn("_p", tx.places_of(F.col(token))), "tokens")
    distinct = t.where("_v IS NOT NULL").select("_v", "_p").distinct()
    vals = materialise(values.select(number(F.col(value)).alias("_c")).distinct(), "results").where("_c IS NOT NULL")
    exact = distinct.join(vals, distinct["_v"] == vals["_c"], "left_semi")
    near, spread = exact.limit(0), rounded_results(vals, distinct)
    if spread is not None:
        first = -F.col("_c.exp")
        to_zero = F.max(F.when(F.col("_c.sign") != 0, F.when(F.col("_c.digits") < "5", first).otherwise(first - 1)))
        zero = vals.agg(to_zero.alias("p")).collect()[0]["p"]
        near = distinct.join(spread, ["_v", "_p"], "left_semi")
        if zero is not None:
            near = near.unionByName(distinct.where((F.col("_v.sign") == 0) & (F.col("_p") <= zero)))
    hit = exact.unionByName(near).distinct().withColumn("_hit", F.lit(True))
    return t.join(hit, (t["_v"] == hit["_v"]) & t["_p"].eqNullSafe(hit["_p"]), "left").select(
        *[t[c] for c in columns], F.coalesce("_hit", F.lit(False)).alias("traced")
    )


def trace_report(traced: DataFrame, context: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts of traced, contextual and untraced numbers; ``context`` lists declared design numbers."""
    c = context.select(*key).distinct().withColumn("_ctx", F.lit(True))
    j = traced.join(c, list(key), "left")
    kind = F.when(F.col("traced"), "traced").when(F.col("_ctx"), "context").otherwise("untraced")
    return j.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def extract_all(df: DataFrame, column: str, pattern: str, keep: Sequence[str], group: int = 1, sep: str = ",") -> DataFrame:
    """(keep, key): every captured key, lists split and trimmed."""
    found = F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(group)))
    each = df.select(*keep, found.alias("_m")).select(*keep, F.explode(F.split("_m", sep)).alias("key"))
    return each.select(*keep, F.trim("key").alias("key")).where("key <> ''")


def uncited(refs: DataFrame, cited: DataFrame, key: str = "key") -> DataFrame:
    """Reference rows no document cites."""
    return refs.join(cited.select(key).distinct(), key, "left_anti")


def dup_groups(df: DataFrame, key: Sequence[str], item: str) -> DataFrame:
    """Groups of two or more rows on a key, with the size and the smallest id. Members stay rows."""
    ok = F.lit(True)
    for k in key:
        ok &= F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return df.where(ok).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first")).where("n > 1")


def dup_titles(df: DataFrame, title: str, item: str) -> DataFrame:
    return dup_groups(df.withColumn("norm", tx.norm_title(F.col(title))), ["norm"], item)


SLOT = ("venue", "volume", "issue", "pages")


def _slot_key(slot: Sequence[str]) -> list[Column]:
    """The place an entry claims: the publication as a title, the rest as tokens, empty where nothing is given."""
    norm = [tx.norm_title if i == 0 else tx.norm_token for i in range(len(slot))]
    return [F.coalesce(f(F.col(c).cast("string")), F.lit("")) for f, c in zip(norm, slot)]


def dup_slots(df: DataFrame, item: str, slot: Sequence[str] = SLOT, optional: Sequence[str] = ("issue",)) -> DataFrame:
    """Rows claiming the same place in the same publication, compared in normalised form.

    Columns in ``optional`` may be empty; a row without one of the others claims no place.
    """
    keyed = df.select(item, *[k.alias(c) for k, c in zip(_slot_key(slot), slot)])
    for c in slot:
        if c not in optional:
            keyed = keyed.where(F.col(c) != "")
    return keyed.groupBy(*slot).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first")).where("n > 1")


def best_match(refs: DataFrame, records: DataFrame, key: str = "key") -> DataFrame:
    """The candidate record most similar in title, per reference. Candidates carry the reference key."""
    r = records.where(F.coalesce("title", F.lit("")) != "").select(key, F.struct(*[c for c in records.columns if c != key]).alias("rec"))
    j = refs.select(key, F.col("title").alias("_t")).join(r, key)
    sim = tx.title_sim(F.col("_t"), F.col("rec.title"))
    return j.withColumn("sim", sim).groupBy(key).agg(
        F.min_by("rec", F.struct(-F.col("sim"), F.col("rec.doi"))).alias("rec"), F.max("sim").alias("similarity")
    )


def _overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def audit_entries(refs: DataFrame, records: DataFrame, cited: DataFrame) -> DataFrame:
    """Flags and tier per reference.

    Fields are compared only under a confident title match. In a duplicate group a
    confirmed entry is the genuine one and its unconfirmed copies are suspect; group
    counts of confirmed entries decide that, so no two entries are ever paired.
    """
    m = refs.join(best_match(refs, records), "key", "left")
    strong = F.coalesce(F.col("similarity") >= tx.STRONG_MATCH, F.lit(False))
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    both = lambda c: strong & some(c) & some(f"rec.{c}")
    authors = strong & (F.size("surnames") > 0) & (F.size("rec.surnames") > 0) & ~_overlap(F.col("surnames"), F.col("rec.surnames"))
    fields = (
        (both("volume") & (tx.norm_token(F.col("volume")) != tx.norm_token(F.col("rec.volume"))))
        | (both("pages") & ~tx.pages_agree(F.col("pages"), F.col("rec.pages")))
        | (both("year") & (F.col("year") != F.col("rec.year")))
    )
    d = m.withColumn("f_author", F.coalesce(authors, F.lit(False))).withColumn("f_volume", F.coalesce(fields, F.lit(False)))
    d = d.withColumn("resolved", strong).withColumn("confirmed", strong & ~F.col("f_author") & ~F.col("f_volume"))
    d = d.withColumn("norm", tx.norm_title(F.col("title")))
    cite = cited.select("key").distinct().withColumn("_cited", F.lit(True))
    d = d.join(cite, "key", "left")

    def group_flag(df: DataFrame, key: Sequence[str], name: str, flag: str, optional: Sequence[str] = ()) -> DataFrame:
        ok = F.lit(True)
        for k in key:
            if k not in optional:
                ok &= F.coalesce(F.col(k).cast("string"), F.lit("")) != ""
        g = df.where(ok).groupBy(*key).agg(
            F.count(F.lit(1)).alias("_n"), F.count_if(F.col("confirmed")).alias("_nc")
        ).where("_n > 1")
        j = df.join(g, list(key), "left")
        genuine = F.col("confirmed") & (F.col("_nc") == 1)
        return j.withColumn(
            name, F.when(F.col("_n").isNotNull(), F.when(genuine, DUPLICATED_BY_OTHER).otherwise(flag))
        ).drop("_n", "_nc")

    d = group_flag(d, ["norm"], "_dup_title", DUPLICATE_TITLE)
    slot = [f"_slot_{c}" for c in SLOT]
    d = d.withColumns(dict(zip(slot, _slot_key(SLOT))))
    d = group_flag(d, slot, "_dup_slot", DUPLICATE_SLOT, ["_slot_issue"])
    flags = F.array_distinct(F.array_compact(F.array(
        F.when(~F.col("resolved"), UNRESOLVED), F.when(F.col("f_author"), AUTHOR_MISMATCH),
        F.when(F.col("f_volume"), VOLUME_MISMATCH), F.col("_dup_title"), F.col("_dup_slot"),
        F.when(F.col("_cited").isNull(), UNCITED),
    )))
    d = d.withColumn("flags", flags)
    has = lambda f: F.array_contains("flags", f)
    suspect = has(DUPLICATE_TITLE) | has(DUPLICATE_SLOT) | (has(AUTHOR_MISMATCH) & (has(VOLUME_MISMATCH) | has(UNCITED)))
    clean = F.size(F.array_remove("flags", DUPLICATED_BY_OTHER)) == 0
    tier = F.when(suspect, SUSPECT).when(clean, CONFIRMED).otherwise(UNDECIDED)
    return d.select("key", "similarity", "confirmed", "flags", tier.alias("tier"))
