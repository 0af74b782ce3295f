"""Problem 1: schemas that drift between files.

Every file (granule) writes its variables as JSON objects, one per record.  Between files a
variable may be renamed, dropped, added or written as another type.  The operator

1. reads the *headers* of all files in parallel: for each file the keys it carries and, per key,
   how many values of each type it holds (``file_headers``);
2. resolves keys to variables (``variable_of``) and folds the types of all files through a
   type-promotion lattice (``union_schema``);
3. finds the unit each file writes a variable in (``file_scales``) and casts every record to the
   union schema and the common unit (``to_union_table``);
4. logs the ordered differences of consecutive files of a run (``drift_log``), and apart from them
   the files whose values had to be rescaled (``rescale_log``).

Defined cases: a record that does not parse as one JSON object is not whole and counts nowhere;
repeated records (same record_id of a file) count once, records without record_id are repeats only
if their payload is the same; a null payload, an empty table or a file unknown to
the manifest give no rows; a key that resolves to no known variable is a variable of its own; two
keys of one variable in one file: the one carried by more records names it, ties by name.
Only the documented columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.operators.repeats import split_repeats
from tidemark.session import cut

# Names of the variables as the product documentation writes them (fixed values).
KNOWN_VARIABLES = (
    "time",
    "latitude",
    "longitude",
    "cross_track_distance",
    "ssh_karin",
    "ssh_karin_qual",
    "ssh_karin_2",
    "ssh_karin_2_qual",
    "ssha_karin",
    "ssha_karin_qual",
    "ssha_karin_2",
    "ssha_karin_2_qual",
    "height_cor_xover",
    "height_cor_xover_qual",
    "internal_tide_hret",
    "ancillary_surface_classification_flag",
    "surface_type",
    "swh_karin",
    "swh_karin_qual",
    "wind_speed_karin",
    "wind_speed_karin_qual",
    "rain_flag",
    "dac",
)
# Unit words that a file may append to a name (fixed values).
UNIT_TOKENS = frozenset({"m", "mm", "cm", "km", "deg", "degree", "degrees", "meter", "meters", "metre", "metres"})
# Meanings of the surface classification flag, in code order from 0 (fixed values).
FLAG_MEANINGS = (
    "open_ocean",
    "land",
    "continental_water",
    "aquatic_vegetation",
    "continental_ice_snow",
    "floating_ice",
    "salted_basin",
)
# Words without which a name means another variable, so they can never be left out.
DISTINCTIVE = frozenset({"qual", "flag", "type", "speed"})

TYPES = ("integer", "decimal", "string", "boolean", "list", "object")


def _tokens(name: str) -> tuple[str, ...]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", spaced.lower()) if p]
    return tuple(parts)


def _abbreviates(short: str, long: str) -> bool:
    """``short`` is ``long`` or an abbreviation of it: same first letter, letters in order."""
    if short == long:
        return True
    if len(short) < 2 or len(short) >= len(long) or short[0] != long[0] or short.isdigit():
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def _match(tokens: tuple[str, ...], known: tuple[str, ...]) -> int | None:
    """Cost of reading ``tokens`` as the known name, None where that is impossible."""
    left, cost = list(known), 0
    for t in sorted(tokens, key=lambda x: (x not in known, -len(x))):
        hit = next((k for k in left if k == t), None) or next(
            (k for k in left if _abbreviates(t, k) or _abbreviates(k, t)), None
        )
        if hit is None:
            return None
        cost += 0 if hit == t else 1
        left.remove(hit)
    if any(k.isdigit() or k in DISTINCTIVE for k in left) or len(left) > 1 or (left and len(tokens) < 2):
        return None
    return cost + 10 * len(left)


@lru_cache(maxsize=65536)
def variable_of(key: str, known: tuple[str, ...] = KNOWN_VARIABLES) -> str:
    """The variable a key names: letter case, separators, word order, abbreviations, unit words and
    one dropped qualifier do not matter; unknown keys are variables of their own."""
    tokens = _tokens(key)
    short = tuple(t for t in tokens if t not in UNIT_TOKENS) or tokens
    if not short:
        return key
    glued = "".join(short)
    best: list[tuple[int, str]] = []
    for name in known:
        parts = tuple(name.split("_"))
        cost = 0 if "".join(parts) == glued else _match(short, parts)
        if cost is not None:
            best.append((cost, name))
    best.sort()
    if best and (len(best) == 1 or best[0][0] < best[1][0]):
        return best[0][1]
    return "_".join(sorted(short))


def _variable(known: tuple[str, ...]):
    def names(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else variable_of(k, known))

    return F.pandas_udf(names, StringType())


_WHOLE = "schema_of_variant(try_parse_json(payload)) like 'OBJECT%'"


def whole_records(records: DataFrame) -> DataFrame:
    """(record_id, granule, run_id, v): one parsed row per whole record.

    Records whose id comes once are parsed where they are read; only repeats are shuffled, and of
    these the latest whole one stays.
    """
    rows = records.select("record_id", "granule", "run_id", "received_at", "payload").where("granule is not null and payload is not null")
    key = F.when(F.col("record_id").isNotNull(), F.xxhash64("granule", "run_id", "record_id"))
    once, again = split_repeats(rows.withColumn("_key", key), "_key")
    when = F.coalesce("received_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    same = F.when(F.col("record_id").isNull(), F.xxhash64("payload")).alias("_same")
    # inside the aggregate and the generator, for a filter would be pushed below the split and parse every row there
    latest = F.max(F.when(F.expr(_WHOLE), F.struct(when.alias("w"), "payload")))
    chosen = again.groupBy("granule", "run_id", "record_id", same).agg(latest.getField("payload").alias("payload"))
    names = ["record_id", "granule", "run_id", "payload"]
    whole = F.filter(F.array(F.expr("try_parse_json(payload)")), lambda v: F.schema_of_variant(v).like("OBJECT%"))
    return once.select(*names).unionByName(chosen.select(*names)).select(*names[:3], F.explode(whole).alias("v"))


_TYPE_SQL = """
case when s = 'VOID' then 'null'
     when s = 'BIGINT' or s rlike '^DECIMAL\\\\((19|2[0-9]|3[0-9]),0\\\\)$' then 'integer'
     when s like 'DECIMAL%' or s in ('DOUBLE', 'FLOAT') then 'decimal'
     when s = 'BOOLEAN' then 'boolean'
     when s like 'ARRAY%' then 'list'
     when s like 'OBJECT%' then 'object'
     else 'string' end
"""


def file_headers(records: DataFrame) -> DataFrame:
    """(granule, run_id, key, type, n): values of each type under each key of each file.

    type is one of TYPES or 'null'.  The exploded keys are counted map-side, so only
    files x keys x types rows are shuffled.
    """
    whole = whole_records(records)
    exploded = whole.lateralJoin(
        whole.sparkSession.tvf.variant_explode(F.col("v").outer())
    ).select("granule", "run_id", "key", F.expr("schema_of_variant(value)").alias("s"))
    return exploded.groupBy("granule", "run_id", "key", F.expr(_TYPE_SQL).alias("type")).agg(F.count("*").alias("n"))


def _files(manifest: DataFrame) -> DataFrame:
    """(granule, m_run, file_no), each granule once."""
    f = manifest.select("granule", F.col("run_id").alias("m_run"), "file_no").where("granule is not null and file_no is not null")
    return f.groupBy("granule").agg(F.min(F.struct("m_run", "file_no")).alias("f")).select("granule", "f.m_run", "f.file_no")


def file_variables(records: DataFrame, manifest: DataFrame, known: tuple[str, ...] = KNOWN_VARIABLES) -> DataFrame:
    """(run_id, file_no, variable, key, type): what each file holds.

    type is that of most non-null values (ties: the first of TYPES in alphabetical order), null if
    there are none.
    """
    head = (
        file_headers(records)
        .join(_files(manifest), "granule")
        .withColumn("variable", _variable(known)("key"))
        .select(F.coalesce("m_run", "run_id").alias("run_id"), "file_no", "variable", "key", "type", "n")
    )
    per_key = head.groupBy("run_id", "file_no", "variable", "key").agg(
        F.sum("n").alias("carried"), F.collect_list(F.struct("type", "n")).alias("tn")
    )
    # a variable has few keys and at most seven types in a file, so these lists are tiny
    return (
        per_key.groupBy("run_id", "file_no", "variable")
        .agg(
            F.min(F.struct((-F.col("carried")).alias("c"), F.col("key"))).getField("key").alias("key"),
            F.flatten(F.collect_list("tn")).alias("tn"),
        )
        .withColumn("tn", F.filter("tn", lambda x: x["type"] != "null"))
        .withColumn(
            "type",
            F.expr(
                "array_min(transform(array_distinct(tn.type), t -> struct("
                "-aggregate(filter(tn, x -> x.type = t), 0L, (a, x) -> a + x.n) as c, t as t))).t"
            ),
        )
        .select("run_id", "file_no", "variable", "key", "type")
    )


def numbered_files(held: DataFrame) -> DataFrame:
    """(run_id, file_no, seq, next_file_no, first): the files that hold anything, numbered through all
    runs in order of run and file; first says that the run begins here.

    Files are sorted by range partitions and numbered by partition offsets, so no run is one task.
    """
    w_part = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    rows = held.select("run_id", "file_no").distinct().repartitionByRange("run_id", "file_no").sortWithinPartitions("run_id", "file_no")
    placed = cut(rows.withColumn("_id", F.monotonically_increasing_id()))
    at = placed.select("run_id", "file_no", F.shiftright("_id", 33).alias("_p"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_i"))
    # one row per partition
    offset = at.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(w_part), F.lit(0)).alias("_o"))
    seq = at.join(F.broadcast(offset), "_p").select("run_id", "file_no", (F.col("_o") + F.col("_i") + 1).alias("seq"))
    near = [seq.select((F.col("seq") + d).alias("seq"), F.col("run_id").alias(f"_r{n}"), F.col("file_no").alias(f"_f{n}")) for d, n in ((-1, "next"), (1, "prev"))]
    x = seq.join(near[0], "seq", "left").join(near[1], "seq", "left")
    return x.select(
        "run_id", "file_no", "seq",
        F.when(F.col("_rnext").eqNullSafe(F.col("run_id")), F.col("_fnext")).alias("next_file_no"),
        (F.col("_fprev").isNull() | ~F.col("_rprev").eqNullSafe(F.col("run_id"))).alias("first"),
    )


BLOCK_BITS = 16  # files of a variable that are looked at together: 2 ** BLOCK_BITS


def drift_log(records: DataFrame, manifest: DataFrame, known: tuple[str, ...] = KNOWN_VARIABLES, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(run_id, file_no, change_kind, old_name, new_name): every change where it sets in.

    Windows are per variable and block of files, with the files next to the block; what a block
    must know of earlier ones, the last type since the variable was added, is handed on in one row
    per block. Order the rows by run_id, file_no to read them as a log.
    """
    held = cut(file_variables(records, manifest, known))
    v = held.join(numbered_files(held), ["run_id", "file_no"])

    def event(kind, when, old, new, file_no=None):
        old, new = (F.lit(c) if isinstance(c, str) else c for c in (old, new))
        at = F.col("file_no") if file_no is None else file_no
        return F.when(when, F.struct(at.alias("f"), F.lit(kind).alias("k"), old.alias("o"), new.alias("w")))

    def block(seq):
        return F.shiftright(seq, block_bits)

    near = F.array_distinct(F.array(*[block(F.col("seq") + d) for d in (0, -1, 1)]))
    w = Window.partitionBy("variable", "block").orderBy("seq")
    x = v.withColumn("block", F.explode(near)).withColumn("own", block(F.col("seq")) == F.col("block"))
    # neighbours in the numbering follow each other unless a run begins between them
    follows = (F.lag("seq").over(w) == F.col("seq") - 1) & ~F.col("first")
    x = (
        x.withColumn("fresh", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
        .withColumn("p_key", F.lag("key").over(w))
        .withColumn("stays", F.coalesce((F.lead("seq").over(w) == F.col("seq") + 1) & ~F.lead("first").over(w), F.lit(False)))
        .withColumn("stay", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    w_stay = Window.partitionBy("variable", "block", "stay").orderBy("seq")
    before, until = w_stay.rowsBetween(Window.unboundedPreceding, -1), w_stay.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("p_type", F.last("type", ignorenulls=True).over(before)).withColumn("l_type", F.last("type", ignorenulls=True).over(until)).where("own")
    ends = x.groupBy("variable", "block").agg(F.max("fresh").alias("broke"), F.max(F.struct("seq", "l_type")).getField("l_type").alias("l_type"))
    earlier = Window.partitionBy("variable").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known_type = F.when(F.col("l_type").isNotNull() | (F.col("broke") == 1), F.struct("l_type"))
    carried = ends.select("variable", "block", F.last(known_type, ignorenulls=True).over(earlier).getField("l_type").alias("carried"))
    # the first stay of a block goes on from the block before if its first file does
    w_block = Window.partitionBy("variable", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(carried, ["variable", "block"]).withColumn("goes_on", F.max("fresh").over(w_block) == 0)
    x = x.withColumn("p_type", F.coalesce("p_type", F.when(F.col("goes_on"), F.col("carried"))))
    return x.select(
        "run_id",
        F.explode(
            F.filter(
                F.array(
                    event("added", (F.col("fresh") == 1) & ~F.col("first"), "", F.col("key")),
                    event("renamed", (F.col("fresh") == 0) & (F.col("p_key") != F.col("key")), F.col("p_key"), F.col("key")),
                    event("retyped", F.col("type").isNotNull() & (F.col("p_type") != F.col("type")), F.col("p_key"), F.col("key")),
                    event("removed", F.col("next_file_no").isNotNull() & ~F.col("stays"), F.col("key"), "", F.col("next_file_no")),
                ),
                lambda e: e.isNotNull(),
            )
        ).alias("e"),
    ).select(
        F.col("run_id").cast("int").alias("run_id"),
        F.col("e.f").cast("int").alias("file_no"),
        F.col("e.k").alias("change_kind"),
        F.col("e.o").alias("old_name"),
        F.col("e.w").alias("new_name"),
    )


# --- union schema -----------------------------------------------------------------------------

# Height of each type in the lattice; the join of two types is the higher one, and a list or an
# object of one scalar is read as that scalar.
_LATTICE = {"null": 0, "boolean": 1, "integer": 2, "decimal": 3, "string": 4}
_NUMBER = r"^\\s*([-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\\s*(mm|cm|km|m|deg)?\\s*$"
# Metres in each unit of length that a value may carry (fixed values).
_UNIT_M = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0}
_MISSING = "('nan', 'null', 'none', '')"


def promote(a: str, b: str) -> str:
    """Join of two scalar types in the promotion lattice (commutative, associative, idempotent)."""
    return a if _LATTICE[a] >= _LATTICE[b] else b


def _scalar(v: str) -> str:
    """SQL text of the scalar inside a variant: an object's ``value``, the element of a list of one;
    other objects and lists as JSON text."""
    return (
        f"case when schema_of_variant({v}) like 'OBJECT%' then if(try_variant_get({v}, '$.value', 'variant') is null, to_json({v}), try_variant_get({v}, '$.value', 'string')) "
        f"when schema_of_variant({v}) like 'ARRAY%' then if(try_variant_get({v}, '$[1]', 'variant') is null, try_variant_get({v}, '$[0]', 'string'), to_json({v})) "
        f"else try_variant_get({v}, '$', 'string') end"
    )


def _kind(x: str) -> str:
    """SQL text of the place in the lattice of a scalar's text."""
    return f"""case when {x} is null or lower({x}) in {_MISSING} then 'null'
        when lower({x}) in ('true', 'false') then 'boolean'
        when {x} rlike '^\\\\s*[-+]?[0-9]+\\\\s*$' then 'integer'
        when {x} rlike '{_NUMBER}' then 'decimal'
        when lower({x}) in ({", ".join(repr(m) for m in FLAG_MEANINGS)}) then 'integer'
        else 'string' end"""


def union_schema(whole: DataFrame, known: tuple[str, ...] = KNOWN_VARIABLES, max_keys: int = 10_000) -> dict[str, tuple[str, list[str]]]:
    """{variable: (type, keys)}: the types of all values of all files folded through the lattice.

    Only distinct (key, type) pairs reach the driver: the width of the schema, not the data.  A
    table with more than ``max_keys`` different keys raises rather than overrun the driver.
    """
    pairs = (
        whole.lateralJoin(whole.sparkSession.tvf.variant_explode(F.col("v").outer()))
        .where("key is not null")
        .select("key", F.expr(f"transform(array({_scalar('value')}), x -> {_kind('x')})[0]").alias("kind"))
        .distinct()
        .limit(max_keys * len(_LATTICE) + 1)
        .collect()
    )
    if len({p["key"] for p in pairs}) > max_keys:
        raise ValueError(f"more than {max_keys} different keys: not one schema that drifts")
    out: dict[str, tuple[str, list[str]]] = {}
    for p in sorted(pairs, key=lambda p: (p["key"], p["kind"])):
        name = variable_of(p["key"], known)
        kind, keys = out.get(name, ("null", []))
        out[name] = (promote(kind, p["kind"]), sorted({*keys, p["key"]}))
    return dict(sorted(out.items()))


def _texts(whole: DataFrame, schema: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(record_id, granule, run_id, t: array<struct<t, u>>): of every variable, in the order of the
    schema, the text of its scalar and the unit an object gives it."""
    parts = []
    for _, keys in schema.values():
        quoted = ["$['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys]
        v = "coalesce(" + ", ".join(f'try_variant_get(v, "{q}", \'variant\')' for q in quoted) + ", cast(null as variant))"
        parts.append(f"transform(array({v}), x -> named_struct('t', {_scalar('x')}, 'u', try_variant_get(x, '$.units', 'string')))[0]")
    return whole.select("record_id", "granule", "run_id", *[F.expr(p).alias(f"_t{i}") for i, p in enumerate(parts)])


def _numbers(texts: DataFrame, schema: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Texts with, for every numeric variable i, its number ``_n{i}`` as written and the metres in
    its own unit ``_m{i}`` (null if it carries none)."""
    flags = " ".join(f"when lower(x) = '{m}' then {i}D" for i, m in enumerate(FLAG_MEANINGS))
    unit = "lower(coalesce(u, nullif(regexp_extract(t, '" + _NUMBER + "', 2), '')))"
    metres = " ".join(f"when x = '{u}' then {m}D" for u, m in _UNIT_M.items())
    for i, (kind, _) in enumerate(schema.values()):
        if kind in ("integer", "decimal"):
            number = f"case when lower(x) = 'true' then 1D when lower(x) = 'false' then 0D {flags} else try_cast(regexp_extract(x, '{_NUMBER}', 1) as double) end"
            texts = texts.withColumn(f"_n{i}", F.expr(f"transform(array(_t{i}.t), x -> {number})[0]"))
            texts = texts.withColumn(f"_m{i}", F.expr(f"transform(array(_t{i}), s -> transform(array({unit.replace('coalesce(u', 'coalesce(s.u').replace('extract(t', 'extract(s.t')}), x -> case {metres} end)[0])[0]"))
    return texts


def _scales(numbers: DataFrame, schema: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(granule, _f0, _f1, ...): what each file's unmarked values of a decimal variable are to be
    multiplied by, 1 unless the file writes integers of another magnitude than the other files do."""
    decimal = [i for i, (kind, _) in enumerate(schema.values()) if kind == "decimal"]
    aggs = []
    for i in decimal:
        plain = F.col(f"_m{i}").isNull() & F.col(f"_n{i}").isNotNull()
        whole = F.col(f"_t{i}.t").rlike(r"^\s*[-+]?[0-9]+\s*$")
        # a file's values are few; so are those of a group here
        aggs += [
            F.percentile(F.when(plain & (F.col(f"_n{i}") != 0), F.abs(f"_n{i}")), 0.5).alias(f"_size{i}"),
            (F.count_if(plain & whole) > F.count_if(plain & ~whole)).alias(f"_ints{i}"),
        ]
    files = numbers.groupBy("granule").agg(F.lit(1).alias("_one"), *aggs)
    usual = files.agg(F.lit(1).alias("_one_"), *[F.percentile_approx(F.when(~F.col(f"_ints{i}"), F.col(f"_size{i}")), 0.5, 10_000).alias(f"_usual{i}") for i in decimal])
    x = files.join(F.broadcast(usual))  # one row
    power = {i: F.least(F.greatest(F.round(F.log10(F.col(f"_size{i}") / F.col(f"_usual{i}"))), F.lit(0.0)), F.lit(3.0)) for i in decimal}
    factors = [F.coalesce(F.when(F.col(f"_ints{i}"), F.element_at(F.array(*[F.lit(f) for f in (1.0, 0.1, 0.01, 0.001)]), (power[i] + 1).cast("int"))), F.lit(1.0)).alias(f"_f{i}") for i in decimal]
    return x.select("granule", *factors)


def file_scales(records: DataFrame, known: tuple[str, ...] = KNOWN_VARIABLES) -> DataFrame:
    """(granule, variable, factor): files whose unmarked values of a variable are in another unit.

    A value that carries a unit (an object's ``units``, a suffix) is converted by it.  Where values
    carry none, a file that writes integers while the variable's other files write decimals is in
    millimetres, centimetres or decimetres if the median size of its values is nearest to 1000, 100
    or 10 times the usual median of the other files; a unit in the key does not count against that.
    """
    whole = whole_records(records)
    schema = union_schema(whole, known)
    x = _scales(_numbers(_texts(whole, schema), schema), schema)
    names = list(schema)
    pairs = [F.struct(F.lit(names[int(c[2:])]).alias("variable"), F.col(c).alias("factor")) for c in x.columns if c.startswith("_f")]
    if not pairs:
        return x.select("granule", F.lit("").alias("variable"), F.lit(1.0).alias("factor")).where("false")
    return x.select("granule", F.explode(F.array(*pairs)).alias("z")).where("z.factor != 1").select("granule", "z.variable", "z.factor")


def rescale_log(records: DataFrame, manifest: DataFrame, known: tuple[str, ...] = KNOWN_VARIABLES) -> DataFrame:
    """(run_id, file_no, variable, factor): the files whose values of a variable were rescaled."""
    x = file_scales(records, known).join(_files(manifest), "granule")
    return x.select(F.col("m_run").cast("int").alias("run_id"), F.col("file_no").cast("int").alias("file_no"), "variable", "factor")


def to_union_table(records: DataFrame, known: tuple[str, ...] = KNOWN_VARIABLES) -> DataFrame:
    """One row per whole record, one column of one type and one unit per variable.

    Lengths are in metres (``file_scales`` says how units are found).  A variable that only ever held
    nulls is a string column; text that is no number becomes null in a numeric column only if it
    spells a missing value, for otherwise the lattice has made the column a string.
    """
    whole = whole_records(records)
    schema = union_schema(whole, known)
    x = _numbers(_texts(whole, schema), schema)
    if any(kind == "decimal" for kind, _ in schema.values()):
        x = x.join(_scales(x, schema), "granule")
    cols = []
    for i, (name, (kind, _)) in enumerate(schema.items()):
        t = F.col(f"_t{i}.t")
        if kind == "decimal":
            f = F.coalesce(F.col(f"_m{i}"), F.col(f"_f{i}"))
            col = F.when(f < 1, F.col(f"_n{i}") / F.round(1 / f)).otherwise(F.col(f"_n{i}") * f)  # 18 mm are 0.018 m
        elif kind == "integer":
            col = F.col(f"_n{i}").cast("bigint")
        elif kind == "boolean":
            col = t.try_cast("boolean")
        else:
            col = F.when(~F.lower(t).isin("nan", "null", "none", ""), t)
        cols.append(col.alias(name))
    return x.select("record_id", "granule", "run_id", *cols)
