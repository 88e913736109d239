"""Signature text -> parameter list -> JSON parameter schema.

Everything is a Column expression (higher-order array functions), so the
whole stage stays inside whole-stage code generation; there is no Python
worker on this path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsontext as J

# Characters removed by a bare ``str.strip()`` of the original code: every
# character Python calls whitespace (rule, not a table).
# FIXED VALUES: the regex that splits parameters at commas that are not inside
# ``[...]`` (Java syntax, ``[`` escaped), the Python type names of parsed
# defaults and the type words rewritten when the schema is built.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
PARAM_SPLIT = r",\s*(?![^\[]*\])"
DEFAULT_TYPE_NAME = {"null": "NoneType", "bool": "bool", "str": "str", "int": "int", "float": "float"}
SCHEMA_TYPE_WORD = {"none": "null", "true": "boolean", "false": "boolean", "int": "integer"}


def pystrip(c: Column, chars: str = PY_WHITESPACE) -> Column:
    return F.btrim(c, F.lit(chars))


def _ascii_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` (a lambda): Catalyst does not
    share common sub-expressions inside higher-order functions, so a value
    used several times is bound through a one-element ``transform``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _float_layout(a: Column) -> Column:
    """Python ``repr`` layout of a non-negative Java double text with exponent."""
    def body(m):
        mant, e_java = m["mant"], m["e"]
        int_part = F.substring_index(mant, ".", 1)
        frac = F.substring_index(mant, ".", -1)
        return let(F.struct(int_part.alias("i"), F.concat(int_part, frac).alias("raw"), e_java.alias("e")),
                   lambda r: let(F.struct(
                       F.regexp_replace(F.regexp_replace(r["raw"], "^0+", ""), "0+$", "").alias("d"),
                       (F.length(r["i"]) + r["e"]
                        - (F.length(r["raw"]) - F.length(F.regexp_replace(r["raw"], "^0+", "")))).alias("pt")),
                       lambda q: _layout(q["d"], q["pt"])))
    return let(F.struct(F.substring_index(a, "E", 1).alias("mant"),
                        F.substring_index(a, "E", -1).cast("int").alias("e")), body)


def _layout(digits: Column, point: Column) -> Column:
    nd = F.length(digits)
    exp10 = point - 1
    plain = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)) \
             .when(point >= nd, F.concat(digits, F.repeat(F.lit("0"), point - nd), F.lit(".0"))) \
             .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1, nd)))
    sci_m = F.when(nd > 1, F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."),
                                    F.substr(digits, F.lit(2), nd))).otherwise(digits)
    sci = F.concat(sci_m, F.lit("e"), F.when(exp10 < 0, F.lit("-")).otherwise(F.lit("+")),
                   F.lpad(F.abs(exp10).cast("string"), 2, "0"))
    return F.when((exp10 < -4) | (exp10 >= 16), sci).otherwise(plain)


def py_float_text(x: Column) -> Column:
    """Render a double the way Python's ``repr(float)`` does.

    Spark prints doubles like Java; both print the shortest digits and agree
    in plain notation, but Java switches to ``1.0E-5`` / ``1.2345678E7`` form
    outside [1e-3, 1e7) while Python uses plain notation in [1e-4, 1e16) and
    writes ``1e-05`` / ``1.5e+16`` beyond.  Only texts with an exponent are
    re-laid out.
    """
    def body(j):
        a = F.regexp_replace(j, "^-", "")
        sign = F.when(F.startswith(j, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        lay = F.when(a == "Infinity", F.lit("inf")).when(a == "NaN", F.lit("nan")) \
               .when(F.contains(a, F.lit("E")), _float_layout(a)).otherwise(a)
        return F.concat(sign, lay)
    return F.when(x.isNotNull(), let(x.cast("string"), body))


def parse_default(d: Column) -> Column:
    """Default text -> struct(kind, json) with kind in
    null / bool / str / int / float; ``json`` is the JSON literal.

    Integers and floats that do not convert (``1-2``, ``1.2.3``) stay raw
    text (the original aborted); digit tests are ASCII only.  ``d`` should be
    a cheap expression (a lambda variable or field).
    """
    raw = F.struct(F.lit("str").alias("kind"), J.quote(d).alias("json"))
    int_like = d.rlike("^-*[0-9][-0-9]*$")
    float_like = d.rlike(r"^[-.]*[0-9][-.0-9]*$")
    # an integer of any length: one sign at most, no leading zeros but for 0 itself
    negative = F.startswith(d, F.lit("-"))
    digits = F.ltrim(F.regexp_replace(d, "^-", ""), F.lit("0"))
    as_int = F.when(d.rlike("^-?[0-9]+$"), F.when(digits == "", F.lit("0")).otherwise(
        F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits)))
    as_float = F.when(d.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), d.try_cast("double"))
    return (F.when(F.lower(d) == "none", F.struct(F.lit("null").alias("kind"), F.lit("null").alias("json")))
             .when(d.isin("True", "False"),
                   F.struct(F.lit("bool").alias("kind"), F.lower(d).alias("json")))
             .when(F.startswith(d, F.lit("'")) | F.startswith(d, F.lit('"')),
                   F.struct(F.lit("str").alias("kind"), J.quote(F.btrim(d, F.lit("'\""))).alias("json")))
             .when(int_like,
                   F.when(as_int.isNotNull(),
                          F.struct(F.lit("int").alias("kind"), as_int.alias("json")))
                   .otherwise(raw))
             .when(float_like,
                   F.when(as_float.isNotNull(),
                          F.struct(F.lit("float").alias("kind"), py_float_text(as_float).alias("json")))
                   .otherwise(raw))
             .otherwise(raw))


def parse_type(ann: Column) -> Column:
    """Annotation -> array of type words (lower case).

    ``A | B`` gives the distinct words sorted (the original kept set order),
    ``none`` -> ``null``, ``os.pathlike...`` -> ``string``.
    """
    def word(t):
        return F.when(t == "none", F.lit("null")).when(F.startswith(t, F.lit("os.pathlike")), F.lit("string")) \
                .otherwise(t)
    union = F.array_sort(F.array_distinct(F.transform(
        F.transform(F.split(ann, r"\|", -1), lambda t: F.lower(pystrip(t))), word)))
    single = F.when(F.startswith(F.lower(ann), F.lit("os.pathlike")), F.array(F.lit("string"))) \
              .otherwise(F.array(F.lower(ann)))
    return F.when(F.contains(ann, F.lit("|")), union).otherwise(single)


def inside(sig: Column) -> Column:
    """What stands in a signature's own parentheses: one outer pair, no return annotation."""
    return F.regexp_replace(F.regexp_replace(sig, r"(?s)\)\s*->.*$", ")"), r"(?s)^\s*\((.*)\)\s*$", "$1")


def split_at_depth_zero(body: Column) -> Column:
    """Pieces between commas that no bracket or quote encloses.

    A fold over the pieces of a plain split: a piece is joined to the one before while
    that one has brackets (outside its quotes) or quotes left open.
    """
    def open_in(t):
        bare = F.regexp_replace(t, r"'[^']*'|\"[^\"]*\"", "")
        count = lambda chars: F.length(bare) - F.length(F.translate(bare, chars, ""))
        return (count("([{") > count(")]}")) | bare.contains("'") | bare.contains('"')

    def add(acc, piece):
        last = F.get(acc, F.size(acc) - 1)
        glued = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(","), piece)))
        return F.when((F.size(acc) > 0) & open_in(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))), glued) \
                .otherwise(F.concat(acc, F.array(piece)))

    return F.aggregate(F.split(body, ",", -1), F.array().cast("array<string>"), add)


def split_params(sig: Column) -> Column:
    """E1 first half: strip outer parentheses, cut the return annotation,
    split at commas outside ``[...]``."""
    body = F.substring_index(F.btrim(sig, F.lit("()")), ") ->", 1)
    return F.split(body, PARAM_SPLIT, -1)


def _pieces(p: Column, i: Column) -> Column:
    """name-and-type text and default text of one parameter."""
    def body(eq):
        before = F.when(eq > 0, F.substr(p, F.lit(1), eq - 1)).otherwise(p)
        after = F.when(eq > 0, pystrip(F.substr(p, eq + 1, F.length(p))))
        return F.struct(i.alias("pos"), pystrip(before).alias("nt"), after.alias("dtext"))
    return let(F.instr(p, "="), body)


def _named(x: Column) -> Column:
    def body(colon):
        nt = x["nt"]
        name = F.when(colon > 0, pystrip(F.substr(nt, F.lit(1), colon - 1))).otherwise(nt)
        ann = F.when(colon > 0, F.btrim(pystrip(F.substr(nt, colon + 1, F.length(nt))), F.lit("'")))
        return F.struct(x["pos"].alias("pos"), name.alias("name"), ann.alias("ann"), x["dtext"].alias("dtext"))
    return let(F.instr(x["nt"], ":"), body)


def _typed(x: Column) -> Column:
    dflt_map = F.create_map(*[F.lit(v) for kv in DEFAULT_TYPE_NAME.items() for v in kv])
    def body(default):
        ann_types = F.when(x["ann"].isNotNull() & (x["ann"] != ""), parse_type(x["ann"]))
        types = F.coalesce(ann_types, F.when(default.isNotNull(), F.array(dflt_map[default["kind"]])))
        return F.struct(x["pos"].alias("pos"), x["name"].alias("name"), types.alias("types"),
                        x["dtext"].isNotNull().alias("has_default"), default.alias("default"))
    return let(F.when(x["dtext"].isNotNull(), parse_default(x["dtext"])), body)


def parse_signature(sig: Column) -> Column:
    """``array<struct<pos, name, types, has_default, default<kind, json>>>``.

    Skips ``*args``/``**kw``, empty parts and ``self``; a name seen twice keeps
    its first position and its last value (dict semantics of the original).
    """
    pieces = F.transform(split_params(sig), _pieces)
    named = F.filter(F.transform(pieces, _named),
                     lambda x: ~(F.startswith(x["name"], F.lit("*")) | (x["name"] == "")
                                 | (x["name"] == "self")))
    typed = F.transform(named, _typed)
    # fold keeps the first position of a name and the last value seen for it
    empty = F.filter(typed, lambda x: F.lit(False))
    deduped = F.aggregate(typed, empty, lambda acc, x: F.when(
        F.exists(acc, lambda y: y["name"] == x["name"]),
        F.transform(acc, lambda y: F.when(y["name"] == x["name"], x.withField("pos", y["pos"])).otherwise(y)))
        .otherwise(F.concat(acc, F.array(x))))
    return deduped


def _schema_word(t: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SCHEMA_TYPE_WORD.items() for x in kv])
    return F.coalesce(m[t], t)


def parameter_schema(params: Column) -> Column:
    """E5: parameter list -> ``{"type": "object", "properties": {...}}`` text.

    One type is written as a string, several as a list; ``default`` only when
    present; a bare parameter is ``{}``.
    """
    def prop(x):
        def body(words):
            tjson = F.when(F.size(words) > 1, J.array_text(words)).otherwise(F.element_at(words, 1))
            inner = J.obj(("type", tjson), ("default", x["default"]["json"]))
            return F.concat(J.quote(x["name"]), F.lit(": "), inner)
        return let(F.transform(x["types"], lambda t: J.quote(_schema_word(t))), body)
    # a null parameter list gives a null schema: every step below keeps nulls
    props = F.array_join(F.transform(params, prop), ", ")
    return F.concat(F.lit('{"type": "object", "properties": {'), props, F.lit("}}"))


CONSTANT_SCHEMA = '{"type": "constant"}'


def schema_json(kind: Column, sig: Column) -> Column:
    """E6 + E5: constants get ``{"type": "constant"}``, nodes with a signature
    get the parameter schema, anything else has no schema (null)."""
    return F.when(kind == "constant", F.lit(CONSTANT_SCHEMA)) \
            .when(sig.isNotNull() & (sig != ""), parameter_schema(parse_signature(sig)))
