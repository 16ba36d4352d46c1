"""Strict JSON decoding of model responses, in the JVM.

Spark's ``from_json`` ignores trailing text, matches keys case-sensitively and
casts numbers to strings silently.  The reference decoder rejects all of that.
A text is parsed here as a map of VARIANT values: its entries keep their order
and repeated keys, and each value its type.

Shape rules (per known key, keys matched case-insensitively, last one wins):
  * ``str``      JSON string; ``null`` leaves the previous value
  * ``list``     array of strings (a ``null`` element becomes ''); ``null`` -> []
  * ``refs``     array of objects with string ``path`` / ``reason``
Unknown keys are ignored whatever their value.  A top-level ``null`` decodes
to all defaults; any other non-object, a wrong type, trailing text or
non-finite numbers reject the whole text (result NULL).  An unpaired surrogate
escape decodes to U+FFFD.

An object *inside a value* that repeats a key letter by letter is what VARIANT
refuses unless ``spark.sql.variant.allowDuplicateKeys`` is set, as
``session.build_session`` does; without it such a text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACTION_SHAPE = {
    "summary": "str", "goal": "str", "actions": "list", "decisions": "list",
    "blockers": "list", "next_actions": "list", "files_mentioned": "list",
}
PLAN_SHAPE = {
    "title": "str", "goal": "str", "why_now": "str", "current_context": "list",
    "relevant_files": "refs", "execution_plan": "list", "constraints": "list",
    "validation": "list", "expected_output": "str", "copy_ready_prompt": "str",
}
HOOK_SHAPE = {"session_id": "str", "transcript_path": "str", "cwd": "str", "hook_event_name": "str"}

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxNumLen": "1000000"}
_BLANK = " \t\n\r"
_LISTS = ("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
_HEX = "[0-9a-fA-F]{2}"
# A surrogate escape without its partner; a backslash counts if an even number stands before it.
_HIGH = rf"((?<!\\)(?:\\\\)*)\\u[dD][89abAB]{_HEX}(?!\\u[dD][c-fC-F]{_HEX})"
_LOW = rf"(?<!(?<!\\)\\u[dD][89abAB]{_HEX})((?<!\\)(?:\\\\)*)\\u[dD][c-fC-F]{_HEX}"


def _mended(text: Column) -> Column:
    fixed = F.regexp_replace(F.regexp_replace(text, _HIGH, r"$1\\ufffd"), _LOW, r"$1\\ufffd")
    return F.when(F.contains(text, F.lit("\\u")), fixed).otherwise(text)


def _is_one_value(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else: a mark put behind it must be the second of two."""
    mark = F.xxhash64(text).cast("string")
    both = F.from_json(F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]")), "array<string>", _STRICT)
    return F.coalesce((F.size(both) == 2) & (F.get(both, 1) == mark), F.lit(False))


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _known(entries: Column, names: list[str], raw: Column | None = None) -> Column:
    """(k, v, t[, raw]) of the entries with a known key: the key folded, the value and its type."""
    def one(e: Column, r: Column | None = None) -> Column:
        fields = [F.translate(F.lower(e["key"]), "\u017f", "s").alias("k"), e["value"].alias("v"), _type(e["value"]).alias("t")]
        return F.struct(*fields, *([] if r is None else [r["value"].alias("raw")]))

    folded = F.transform(entries, lambda e: one(e)) if raw is None else F.zip_with(entries, raw, one)
    return F.filter(folded, lambda x: x["k"].isin(*names))


def _own(entries: Column, name: str) -> Column:
    return F.filter(entries, lambda x: x["k"] == name)


def _last(entries: Column) -> Column:
    return F.try_element_at(entries, F.lit(-1))


def _str(entries: Column, name: str) -> Column:
    strings = F.filter(entries, lambda x: (x["k"] == name) & (x["t"] == "STRING"))
    return F.coalesce(F.variant_get(_last(strings)["v"], "$", "string"), F.lit(""))


def _list(entries: Column, name: str) -> Column:
    found = F.variant_get(_last(_own(entries, name))["v"], "$", "array<string>")
    return F.coalesce(F.transform(found, lambda s: F.coalesce(s, F.lit(""))), F.array().cast("array<string>"))


def _objects(raw: Column) -> Column:
    """The objects of an array, each as its known entries in order; a null stays null."""
    return F.transform(F.from_json(raw, "array<map<string,variant>>", _STRICT), lambda m: _known(F.map_entries(m), ["path", "reason"]))


def _strings_only(entries: Column) -> Column:
    return F.forall(entries, lambda x: x["t"].isin("STRING", "VOID"))


def _refs_ok(x: Column) -> Column:
    items = F.forall(F.variant_get(x["v"], "$", "array<variant>"), lambda v: _type(v).startswith("OBJECT") | (_type(v) == "VOID"))
    fields = F.forall(_objects(x["raw"]), lambda e: e.isNull() | _strings_only(e))
    return (x["t"] == "VOID") | (x["t"].startswith("ARRAY") & F.coalesce(items & fields, F.lit(False)))


def _refs(entries: Column, name: str) -> Column:
    last = _last(_own(entries, name))
    made = F.transform(_objects(last["raw"]), lambda e: F.struct(
        *[F.when(e.isNull(), F.lit("")).otherwise(_str(e, c)).alias(c) for c in ("path", "reason")]))
    none = F.array().cast("array<struct<path:string,reason:string>>")
    return F.when(last["t"] == "VOID", none).otherwise(F.coalesce(made, none))


_READ = {"str": _str, "list": _list, "refs": _refs}


def strict_decode(text, shape: dict) -> Column:
    """Struct of the shape, or NULL when the text does not decode."""
    col = F.col(text) if isinstance(text, str) else text
    names = {kind: [k for k, v in shape.items() if v == kind] for kind in ("str", "list", "refs")}

    def fits(x: Column) -> Column:
        ok = F.when(x["k"].isin(*names["str"]), x["t"].isin("STRING", "VOID"))
        if names["refs"]:
            ok = ok.when(x["k"].isin(*names["refs"]), _refs_ok(x))
        return ok.otherwise(x["t"].isin(*_LISTS))

    def decoded(e: Column) -> Column:
        return F.when(e.isNotNull() & F.forall(e, fits), F.struct(*[_READ[kind](e, name).alias(name) for name, kind in shape.items()]))

    def read(t: Column) -> Column:
        body = F.btrim(t, F.lit(_BLANK))
        # Of a null all defaults: the entries of an empty object.
        source = F.when(_is_one_value(t) & F.startswith(body, F.lit("{")), body).when(body == "null", F.lit("{}"))
        # The text of each value too: its objects keep the order of their keys there alone.
        raw = F.map_entries(F.from_json(source, "map<string,string>", _STRICT)) if names["refs"] else None
        entries = _known(F.map_entries(F.from_json(source, "map<string,variant>", _STRICT)), list(shape), raw)
        return F.get(F.transform(F.array(entries), decoded), 0)

    # Through arrays of one: what a lambda is given is worked out once.
    return F.get(F.transform(F.array(_mended(col)), read), 0)


def strict_extraction(text) -> Column:
    return strict_decode(text, EXTRACTION_SHAPE)


def strict_plan(text) -> Column:
    return strict_decode(text, PLAN_SHAPE)


def strict_hook_payload(text) -> Column:
    return strict_decode(text, HOOK_SHAPE)
