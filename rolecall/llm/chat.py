"""Chat formatting with tool calls, in DataFrame functions only.

Calls (conv_id, call_id, turn, name, arguments) and results (conv_id, call_id, turn, content) meet in a
hash join on (conv_id, call_id). A call may use results of earlier ones by naming them in objects
``{"$ref": call_id}`` anywhere in its arguments; ``depth`` is the length of the longest chain of such
references, so (depth, turn, call_id) is a topological order. Arguments are checked against the schema of
their tool, at every level, and written as canonical JSON: object keys sorted, no spaces, minimal escapes,
one spelling for each number. A conversation is never gathered: each call is a row with its sort key.

Numbers keep all their digits: ``1e2``, ``100.0`` and ``100`` are ``100``; from 10 ** 21 on and below 10 ** -6
they have an exponent, as ``1e+400`` and ``1.5e-7``. A number that is too large for a double is no problem.

Schemas know ``type`` (one or a list), ``properties``, ``required``, ``additionalProperties`` (true or false),
``items``, ``enum`` (of strings), ``minLength``, ``maxLength``, ``pattern`` (a regular expression of the
engine, searched for), ``minimum``, ``maximum``, ``minItems`` and ``maxItems``, besides ``title`` and
``description``; any other word is an error. An integer may be written with a fraction of zero.

Defined cases: arguments that are no JSON (or repeat a key, or are null) fail with ``not json``; a name
without a schema fails with ``unknown tool``; a call without a result has ``linked`` false; a result
without a call gives a row of its own with the problem ``no call`` and neither turn, name nor depth; several
results of a call, and repeated calls, give a row each. Calls and results without an id or conversation
never link. References to calls that do not exist are ignored; calls on a cycle of references, or behind
one, get the depth null and the problem ``cycle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DOUBLE|DECIMAL.*",
         "boolean": "BOOLEAN", "object": r"OBJECT.*", "array": r"ARRAY.*", "null": "VOID"}
WORDS = {"type", "properties", "required", "additionalProperties", "items", "enum", "minLength", "maxLength",
         "pattern", "minimum", "maximum", "minItems", "maxItems", "title", "description"}
ROUNDS = 4  # levels of references between two writes of the depths
# Stand in for an escaped backslash and an escaped quote: valid JSON has no control characters.
BACKSLASH, QUOTE = "\x01", "\x02"
# How a text is told from a number that is kept as a text while it is sorted.
AS_NUMBER, AS_TEXT = r"\u0001n", r"\u0001s"


def _typed(value: Column, kind: str) -> Column:
    fits = F.schema_of_variant(value).rlike(f"^({TYPES[kind]})$")
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        whole = F.schema_of_variant(value).rlike("^(DOUBLE|DECIMAL.*)$") & (
            (F.abs(number) >= 2.0 ** 53) | (number == F.floor(number)))
        fits = fits | F.coalesce(whole, F.lit(False))
    return fits


def _found(value: Column, rule: dict, label: str) -> list[Column]:
    """A text, or null, for each thing that may be wrong with a variant."""
    unknown = set(rule) - WORDS
    if unknown:
        raise ValueError(f"schema words that are not supported: {', '.join(sorted(unknown))}")
    there = value.isNotNull()
    said = lambda when, word: F.when(there & when, F.lit(f"{word} {label}".strip()))
    found = []
    if "type" in rule:
        kinds = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
        fits = F.lit(False)
        for kind in kinds:
            fits = fits | _typed(value, kind)
        found.append(said(~fits, "type"))
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_text = F.schema_of_variant(value) == "STRING"
    if "minLength" in rule:
        found.append(said(is_text & (F.length(text) < rule["minLength"]), "short"))
    if "maxLength" in rule:
        found.append(said(is_text & (F.length(text) > rule["maxLength"]), "long"))
    if "pattern" in rule:
        found.append(said(is_text & ~text.rlike(rule["pattern"]), "pattern"))
    if "enum" in rule:
        found.append(said(~F.coalesce(text.isin(*rule["enum"]), F.lit(False)), "enum"))
    if "minimum" in rule:
        found.append(said(~is_text & (number < rule["minimum"]), "small"))
    if "maximum" in rule:
        found.append(said(~is_text & (number > rule["maximum"]), "large"))
    if {"items", "minItems", "maxItems"} & set(rule):
        items = F.try_variant_get(value, "$", "array<variant>")
        if "minItems" in rule:
            found.append(said(F.size(items) < rule["minItems"], "few"))
        if "maxItems" in rule:
            found.append(said(F.size(items) > rule["maxItems"], "many"))
        inner, each = rule.get("items", {}), f"{label}[]"

        def first_of(place: int) -> Column:  # the first item that has this fault
            return F.get(F.array_compact(F.transform(items, lambda x: _found(x, inner, each)[place])), 0)

        found += [first_of(place) for place in range(len(_found(value, inner, each)))]
    if {"properties", "required", "additionalProperties"} & set(rule):
        is_object = F.schema_of_variant(value).startswith("OBJECT")
        keys = F.json_object_keys(F.when(is_object, F.to_json(value)))
        path = lambda key: f"{label}.{key}" if label else key
        for key in rule.get("required", ()):
            found.append(F.when(is_object & ~F.array_contains(keys, key), F.lit(f"missing {path(key)}")))
        properties = rule.get("properties", {})
        if not rule.get("additionalProperties", True):
            allowed = F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>")
            text = "unexpected key" + (f" in {label}" if label else "")
            found.append(F.when(is_object & (F.size(F.array_except(keys, allowed)) > 0), F.lit(text)))
        for key, inner in properties.items():
            escaped = key.replace("'", "\\'")
            found += _found(F.try_variant_get(value, f"$['{escaped}']", "variant"), inner, path(key))
    return found


def problems(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Sorted list of what is wrong with the arguments (JSON text) of a tool."""
    parsed = F.try_parse_json(arguments)
    out = F.array(F.when(~name.isin(*schemas) | name.isNull(), F.lit("unknown tool")))
    for tool, schema in schemas.items():
        found = _found(parsed, schema, "")
        if found:
            out = F.when((name == tool) & parsed.isNotNull(), F.array(*found)).otherwise(out)
    out = F.when(parsed.isNull(), F.array(F.lit("not json"))).otherwise(out)
    return F.array_sort(F.array_distinct(F.array_compact(out)))


def _segments(text: Column) -> Column:
    """JSON text cut at its quotes: what is outside of texts, and in between what is inside."""
    text = F.replace(F.replace(text, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    return F.split(text, '"', -1)


def _joined(segments: Column) -> Column:
    text = F.array_join(segments, '"')
    return F.replace(F.replace(text, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))


def spelled(number: Column) -> Column:
    """The one spelling of a JSON number; one with an exponent beyond an integer stays as it is."""
    parts = F.split(F.lower(F.ltrim(number, F.lit("-"))), "e")
    exponent = F.when(F.size(parts) > 1, F.get(parts, 1).try_cast("int")).otherwise(0)
    mantissa = F.split(F.get(parts, 0), r"\.")
    digits = F.concat(F.get(mantissa, 0), F.coalesce(F.get(mantissa, 1), F.lit("")))
    bare = F.ltrim(digits, F.lit("0"))
    point = F.length(F.get(mantissa, 0)) + exponent - (F.length(digits) - F.length(bare))
    bare = F.rtrim(bare, F.lit("0"))
    n, power = F.length(bare), (point - 1).cast("string")
    tail = F.when(n > 1, F.concat(F.lit("."), bare.substr(F.lit(2), n)))
    plain = (
        F.when(n == 0, F.lit("0"))
        .when((n <= point) & (point <= 21), F.rpad(bare, point, F.lit("0")))
        .when((point > 0) & (point <= 21), F.concat(bare.substr(F.lit(1), point), F.lit("."), bare.substr(point + 1, n)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), bare))
        .otherwise(F.concat(bare.substr(F.lit(1), F.lit(1)), F.coalesce(tail, F.lit("")), F.lit("e"),
                            F.when(point > 0, F.lit("+")).otherwise(""), power)))
    sign = F.when(number.startswith("-") & (n > 0), F.lit("-")).otherwise("")
    return F.coalesce(F.concat(sign, plain), number)


def canonical(text: Column) -> Column:
    """Canonical JSON of JSON text; null where it is none.

    Numbers go through the sorting of keys as marked texts, so that no digit is lost.
    """
    def outside(segment: Column) -> Column:
        pieces = F.regexp_extract_all(segment, F.lit("[-+.0-9eE]+|[^-+.0-9eE]+"), F.lit(0))
        marked = F.transform(pieces, lambda p: F.when(
            p.rlike("^-?[0-9]"), F.concat(F.lit(f'"{AS_NUMBER}'), spelled(p), F.lit('"'))).otherwise(p))
        return F.array_join(marked, "")

    def inside(segment: Column) -> Column:
        marker = AS_TEXT[:-1]
        return F.when(segment.startswith(marker), F.concat(F.lit(AS_TEXT), segment.substr(F.lit(len(marker) + 1), F.length(segment)))
                      ).otherwise(segment)

    valid = F.when(F.try_parse_json(text).isNotNull(), text)
    marked = F.transform(_segments(valid), lambda s, i: F.when(i % 2 == 0, outside(s)).otherwise(inside(s)))
    done = F.to_json(F.try_parse_json(_joined(marked)))
    quoted = AS_NUMBER.replace("\\", "\\\\")
    done = F.regexp_replace(done, f'"{quoted}([-+.0-9eE]+)"', "$1")
    return F.replace(done, F.lit(f'"{AS_TEXT}'), F.lit(f'"{AS_TEXT[:-1]}'))


def references(canonical_json: Column) -> Column:
    """The texts of all ``$ref`` members of canonical JSON, at any level."""
    segments = _segments(canonical_json)
    named = F.filter(F.transform(segments, lambda s, i: F.when(
        (i % 2 == 1) & (s == "$ref") & (F.get(segments, i + 1) == ":"), _joined(F.array(F.get(segments, i + 2))))),
        lambda s: s.isNotNull())
    return F.transform(named, lambda s: F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), 0))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): longest chain of references behind each call, without those behind a cycle.

    Chains of single references are cut short by pointer doubling; only calls with several references
    go level by level.
    """
    refs = calls.select("conv_id", "call_id", F.explode(references(canonical(F.col("arguments")))).alias("ref"))
    known = calls.select("conv_id", "call_id").distinct()
    edges = materialize(refs.join(known.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"]).distinct(), "refs")
    counted = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("up"))
    straight = _chains(counted.where("n = 1").select("conv_id", "call_id", "up", F.lit(1).cast("long").alias("w")))
    depth = known.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0).cast("long"))
    depth = materialize(depth, "depths")
    # What calls with several references wait for: the ends of their references' chains.
    ends = straight.select("conv_id", F.col("call_id").alias("ref"), "up", "w")
    links = edges.join(counted.where("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"])
    links = materialize(links.join(ends, ["conv_id", "ref"], "left").select(
        "conv_id", "call_id", F.coalesce("up", "ref").alias("up"),
        (F.coalesce("w", F.lit(0)) + 1).alias("w")), "links")
    fresh, rounds = depth, 0
    while links.limit(1).count() and fresh.limit(1).count():
        met = links.join(depth.withColumnRenamed("call_id", "up"), ["conv_id", "up"], "left")
        ready = met.groupBy("conv_id", "call_id").agg(
            F.max(F.col("depth") + F.col("w")).alias("depth"), F.bool_and(F.col("depth").isNotNull()).alias("all"))
        fresh = materialize(ready.where("all").drop("all").join(
            depth.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "depths")
        depth, rounds = depth.union(fresh), rounds + 1
        if rounds % ROUNDS == 0:  # the plan stays small however long a chain is
            depth = materialize(depth, "depths")
            links = materialize(links.join(depth.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "links")
    hanging = straight.join(depth.withColumnRenamed("call_id", "up"), ["conv_id", "up"]).select(
        "conv_id", "call_id", (F.col("depth") + F.col("w")).alias("depth"))
    return depth.union(hanging)


def _chains(single: DataFrame) -> DataFrame:
    """For calls with one reference, (conv_id, call_id, up, w): the end of their chain and how far it is.

    Pointers double every round, so a chain of n calls takes log n rounds. Chains that end in a cycle
    are left out.
    """
    chain = materialize(single, "chains")
    for _ in range(chain.count().bit_length() + 1):
        onward = chain.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("w").alias("more"))
        moved = materialize(chain.join(onward, ["conv_id", "up"], "left").select(
            "conv_id", "call_id", F.coalesce("next", "up").alias("up"),
            (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.col("next").isNotNull().alias("moved")), "chains")
        chain = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    return chain.join(chain.select("conv_id", F.col("call_id").alias("up")), ["conv_id", "up"], "left_anti")


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, turn, name, depth, linked, result_turn, problems, message) per call and result."""
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments")
    checked = calls.withColumn("problems", problems(F.col("name"), F.col("arguments"), schemas))
    answers = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    known = (checked.join(depths(calls), ["conv_id", "call_id"], "left")
             .withColumn("_call", F.lit(True)))
    rows = known.join(answers.withColumn("_result", F.lit(True)), ["conv_id", "call_id"], "full")
    rows = rows.withColumn("linked", F.col("_call").isNotNull() & F.col("_result").isNotNull())
    rows = rows.withColumn("problems", F.when(F.col("_call").isNull(), F.array(F.lit("no call"))).when(
        F.col("depth").isNull() & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(),
        F.array_sort(F.array_append("problems", F.lit("cycle")))).otherwise(F.col("problems")))
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]"))
    text = lambda c: F.regexp_extract(quoted(F.col(c)), r"(?s)^\[(.*)\]$", 1)
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")),
        F.lit(',"content":'), text("content"), F.lit(',"id":'), text("call_id"),
        F.lit(',"name":'), text("name"), F.lit("}"))
    return rows.select("conv_id", "call_id", "turn", "name", "depth", "linked", "result_turn", "problems",
                       message.alias("message"))
