"""JSON Schema -> Spark Column compiler over VARIANT payloads (V-1 .. V-22).

A rule file is read once on the driver and turned into one Column expression
per source: ``errors = array<string>`` of ``"<path>:<keyword>[(detail)]"``
entries, sorted. No row-at-a-time Python: every check is a built-in
expression, collection checks use higher-order functions (``transform``,
``filter``, ``map_filter``), so the whole validation stays inside
whole-stage code generation.

Semantics kept from draft-07 / 2020-12 as used by the rule files:

* a keyword only tests values of its own type (``minLength`` ignores numbers,
  ``required`` ignores non-objects, ...);
* ``integer`` accepts 25 and 25.0, booleans are not numbers;
* ``required`` counts a present JSON null as present, one error per missing
  key, reported at the parent;
* ``additionalProperties: false`` gives one error at the object;
* ``pattern`` is an unanchored search with ``$`` matching only before ``\\n``;
* ``oneOf`` needs exactly one matching branch (so a number matching both
  ``number`` and ``integer`` fails);
* ``if``/``then``/``else``: an ``if`` whose properties are absent is true;
* ``allOf`` reports the errors of every branch;
* ``format`` is an annotation only (not asserted).

Paths are dotted (``file.rows.3.1``); the root is ``<root>``.
"""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "<root>"

_INT_KINDS = ("BIGINT", "INT", "SMALLINT", "TINYINT")
_NUM_PREFIXES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")


class RuleError(ValueError):
    """A rule uses a keyword this compiler does not know (fails before reading data)."""


_KNOWN = {
    "$schema", "$id", "title", "description", "format", "type", "properties", "required",
    "additionalProperties", "enum", "const", "minLength", "maxLength", "pattern", "minimum",
    "maximum", "minItems", "minProperties", "items", "oneOf", "allOf", "if", "then", "else",
}


# ---------------------------------------------------------------------------
# variant helpers
# ---------------------------------------------------------------------------


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def kind(v: Column, obj: Column | None = None) -> Column:
    """OBJECT / ARRAY / STRING / BIGINT / DECIMAL(p,s) / DOUBLE / BOOLEAN / VOID.

    Objects and arrays are told apart by a cast, so ``schema_of_variant``
    (which walks the whole value) only runs on scalars. ``obj`` is that cast, where it is a column already.
    """
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when((as_object(v) if obj is None else obj).isNotNull(), F.lit("OBJECT"))
        .when(as_array(v).isNotNull(), F.lit("ARRAY"))
        .otherwise(F.schema_of_variant(v))
    )


def scalar_kind(v: Column) -> Column:
    """``kind`` where the rule wants a scalar: one call a value. An object or array found there is walked whole."""
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def is_number_kind(k: Column) -> Column:
    is_num = F.lit(False)
    for p in _NUM_PREFIXES:
        is_num = is_num | k.startswith(p)
    return is_num


def is_type(v: Column, k: Column, t: str, node=None) -> Column:
    if t == "object":
        return k == "OBJECT"
    if t == "array":
        return k == "ARRAY"
    if t == "string":
        return k == "STRING"
    if t == "boolean":
        return k == "BOOLEAN"
    if t == "null":
        return k == "VOID"
    is_num = node.is_number if node is not None else is_number_kind(k)
    if t == "number":
        return is_num
    if t == "integer":
        x = node.number if node is not None else F.try_variant_get(v, "$", "double")
        whole = k.isin(*_INT_KINDS) | k.rlike(r"^DECIMAL\(\d+,0\)$")
        return is_num & (whole | ((x == F.rint(x)) & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    raise RuleError(f"unknown type {t!r}")


def _lit_path(path: str | Column, key: str | Column) -> str | Column:
    """Child path: plain text while static, a Column only inside lambdas."""
    if isinstance(path, str) and isinstance(key, str):
        return key if path == "" else f"{path}.{key}"
    k = F.lit(key) if isinstance(key, str) else key.cast("string")
    if isinstance(path, str):
        return k if path == "" else F.concat(F.lit(path + "."), k)
    return F.concat(path, F.lit("."), k)


def _err(path: str | Column, keyword: str, detail: Column | str | None = None) -> Column:
    if isinstance(path, str):
        text = (path or ROOT) + ":" + keyword
        if isinstance(detail, str):
            return F.lit(f"{text}({detail})")
        parts = [F.lit(text)]
        if detail is not None:
            parts += [F.lit("("), detail, F.lit(")")]
        return F.concat(*parts) if len(parts) > 1 else parts[0]
    shown = path  # dynamic paths always hold at least one index
    parts = [shown, F.lit(":" + keyword)]
    if detail is not None:
        parts += [F.lit("("), F.lit(detail) if isinstance(detail, str) else detail, F.lit(")")]
    return F.concat(*parts)


# Errors are gathered as one text, each behind a separator: a chain of array expressions grew into a method too long
# for the JVM to compile.  Keys of a payload may hold any character, so separators in them are written differently.
_SEP, _ESC = "\x01", "\x02"


def _one(cond: Column, path: Column, keyword: str, detail: Column | str | None = None) -> Column:
    """One error when ``cond`` is true, else none."""
    return F.when(cond, F.concat(F.lit(_SEP), _err(path, keyword, detail))).otherwise(_empty())


def _escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit(_ESC), F.lit(_ESC + "b")), F.lit(_SEP), F.lit(_ESC + "a"))


def _listed(text: Column, escapes: bool) -> Column:
    """ARRAY<STRING> of the gathered errors."""
    errs = F.split(F.substr(text, F.lit(2)), _SEP)
    if escapes:
        errs = F.transform(errs, lambda e: F.replace(F.replace(e, F.lit(_ESC + "a"), F.lit(_SEP)), F.lit(_ESC + "b"), F.lit(_ESC)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(errs)


def _names_keys(schema: Any) -> bool:
    """Whether errors of the rule may name keys that the rule does not list."""
    if isinstance(schema, list):
        return any(map(_names_keys, schema))
    if not isinstance(schema, dict):
        return False
    return bool(isinstance(schema.get("additionalProperties"), dict) and schema["additionalProperties"]) or any(
        map(_names_keys, schema.values()))


def _child(v: Column, key: str) -> Column:
    return F.try_variant_get(v, "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")


def _scalar_eq_any(node, values: list[Any]) -> Column:
    """JSON equality against a list of literal values (strings, numbers, bools, null)."""
    v, k = node.v, node.kind
    cond = F.lit(False)
    for val in values:
        if val is None:
            cond = cond | (k == "VOID")
        elif isinstance(val, bool):
            cond = cond | ((k == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(val)))
        elif isinstance(val, (int, float)):
            cond = cond | (is_type(v, k, "number", node) & (node.number == F.lit(float(val))))
        elif isinstance(val, str):
            cond = cond | ((k == "STRING") & (node.string == F.lit(val)))
        else:
            cond = cond | (F.to_json(v) == F.lit(__import__("json").dumps(val, separators=(",", ":"))))
    return cond


# ---------------------------------------------------------------------------
# compiler
# ---------------------------------------------------------------------------


class _Node:
    """One value position: its variant, and lazily its kind / string / number / map / array."""

    def __init__(self, plan: "RulePlan | None", v: Column, tag: str, scalar: bool = False):
        self.plan, self.v, self.tag, self.scalar = plan, v, tag, scalar
        self._cache: dict[str, Column] = {}

    def _derive(self, what: str, expr: Column) -> Column:
        if what not in self._cache:
            self._cache[what] = self.plan.probe_b(f"{self.tag}_{what}", expr) if self.plan else expr
        return self._cache[what]

    @property
    def kind(self) -> Column:
        return self._derive("k", scalar_kind(self.v) if self.scalar else kind(self.v, self._cache.get("o")))

    @property
    def there(self) -> Column:
        return self._derive("h", self.v.isNotNull())

    @property
    def n_keys(self) -> Column:
        return self._derive("c", F.size(self.obj))

    @property
    def is_number(self) -> Column:
        # asked for by up to three checks, and seven tests long; over the kind itself, as probes of one stage do not see each other
        return self._derive("n", is_number_kind(scalar_kind(self.v) if self.scalar else kind(self.v)))

    @property
    def string(self) -> Column:
        return self._derive("s", F.try_variant_get(self.v, "$", "string"))

    @property
    def number(self) -> Column:
        return self._derive("x", F.try_variant_get(self.v, "$", "double"))

    @property
    def obj(self) -> Column:
        return self._derive("o", as_object(self.v))

    @property
    def arr(self) -> Column:
        return self._derive("a", as_array(self.v))


class RulePlan:
    """Compiled rule: two projection stages of probes, then the error array.

    Stage A opens the payload as a map, once for all its keys, and extracts the
    statically addressed values below them; stage B derives presence / kinds /
    strings / numbers, so that no variant is carried on to the errors. The error expression
    only references these columns, which keeps the generated code small and
    evaluates each extraction once per row. Values inside arrays and extra
    object keys are checked inline in higher-order functions.
    """

    _ids = itertools.count(1)

    def __init__(self, schema: dict[str, Any], payload: Column):
        self._pid = next(RulePlan._ids)
        self.payload = payload
        self.stage_a: list[Column] = []
        self.stage_b: list[Column] = []
        self.names: list[str] = []
        self.nodes = itertools.count(1)
        self._n = 0
        self.keys = self.probe_a("keys", as_object(payload))
        root = _Node(self, payload, "root")
        root._cache["o"] = self.keys
        self.text = _errors(schema, root, "", self, "$")
        # sort_array, not array_sort: the latter has a lambda, and nothing below one is compiled
        self.errors = F.sort_array(_listed(F.col(f"_r{self._pid}_text"), _names_keys(schema)))

    def _name(self, base: str) -> str:
        self._n += 1
        name = f"_r{self._pid}_{self._n}_{base}"
        self.names.append(name)
        return name

    def probe_a(self, base: str, expr: Column) -> Column:
        name = self._name(base)
        self.stage_a.append(expr.alias(name))
        return F.col(name)

    def probe_b(self, base: str, expr: Column) -> Column:
        name = self._name(base)
        self.stage_b.append(expr.alias(name))
        return F.col(name)

    def apply(self, df, out: str = "errors", extra: dict[str, Column] | None = None):
        """Four projections: stage A, stage B, the errors as one text, then the kept columns + errors (+ extra)."""
        keep = [c for c in df.columns]
        staged = df.select("*", *self.stage_a)
        if self.stage_b:
            staged = staged.select("*", *self.stage_b)
        extra_cols = [c.alias(n) for n, c in (extra or {}).items()]
        staged = staged.select(*(staged.columns if extra else keep), self.text.alias(f"_r{self._pid}_text"))
        return staged.select(*keep, self.errors.alias(out), *extra_cols)


def _wants_scalar(schema: dict[str, Any] | bool | None) -> bool:
    types = schema.get("type") if isinstance(schema, dict) else None
    types = types if isinstance(types, list) else [types]
    return all(t in ("string", "number", "integer", "boolean", "null") for t in types)


def _empty() -> Column:
    return F.lit("")


def _child_path(jpath: str, key: str) -> str:
    return jpath + "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _errors(schema: dict[str, Any] | bool, node: _Node, path: str | Column, plan: RulePlan | None,
            jpath: str | None) -> Column:
    """Errors of ``node`` against ``schema`` as one text. ``plan``/``jpath`` are None inside lambdas."""
    if schema is True or schema == {}:
        return _empty()
    if schema is False:
        return _one(node.there, path, "false")
    unknown = set(schema) - _KNOWN
    if unknown:
        raise RuleError(f"unsupported keyword(s): {sorted(unknown)}")

    v = node.v
    parts: list[Column] = []

    def k() -> Column:
        return node.kind

    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = F.lit(False)
        for t in types:
            ok = ok | is_type(v, k(), t, node)
        parts.append(_one(~ok, path, "type"))

    if "enum" in schema:
        parts.append(_one(~_scalar_eq_any(node, schema["enum"]), path, "enum"))
    if "const" in schema:
        parts.append(_one(~_scalar_eq_any(node, [schema["const"]]), path, "const"))

    if any(key in schema for key in ("minLength", "maxLength", "pattern")):
        is_str = k() == "STRING"
        s = node.string
        if "minLength" in schema:
            parts.append(_one(is_str & (F.char_length(s) < schema["minLength"]), path, "minLength"))
        if "maxLength" in schema:
            parts.append(_one(is_str & (F.char_length(s) > schema["maxLength"]), path, "maxLength"))
        if "pattern" in schema:
            # (?d): only \n ends a line, as in Python's re
            parts.append(_one(is_str & ~s.rlike("(?d)" + schema["pattern"]), path, "pattern"))

    if "minimum" in schema or "maximum" in schema:
        is_num = is_type(v, k(), "number", node)
        x = node.number
        if "minimum" in schema:
            parts.append(_one(is_num & (x < F.lit(float(schema["minimum"]))), path, "minimum"))
        if "maximum" in schema:
            parts.append(_one(is_num & (x > F.lit(float(schema["maximum"]))), path, "maximum"))

    if "minItems" in schema or "items" in schema:
        is_arr = k() == "ARRAY"
        arr = node.arr
        if "minItems" in schema:
            parts.append(_one(is_arr & (F.size(arr) < schema["minItems"]), path, "minItems"))
        if "items" in schema:
            item_schema = schema["items"]
            per_item = F.array_join(
                F.transform(arr, lambda el, i: _errors(item_schema, _Node(None, el, ""), _lit_path(path, i), None, None)), ""
            )
            parts.append(F.when(is_arr, per_item).otherwise(_empty()))

    props: dict[str, Any] = schema.get("properties", {})
    needs_obj = "minProperties" in schema or "required" in schema or props or "additionalProperties" in schema
    if needs_obj:
        is_obj = k() == "OBJECT"
        children: dict[str, _Node] = {}

        def child(key: str) -> _Node:
            if key not in children:
                if plan is not None and jpath is not None:
                    # the root's own keys are in its map; a path walks the payload's fields anew
                    cv = F.try_element_at(plan.keys, F.lit(key)) if jpath == "$" else plan.probe_a(
                        "v", F.try_variant_get(plan.payload, _child_path(jpath, key), "variant"))
                    children[key] = _Node(plan, cv, f"n{next(plan.nodes)}", _wants_scalar(props.get(key)))
                else:
                    children[key] = _Node(None, _child(v, key), "")
            return children[key]

        if "minProperties" in schema:
            parts.append(_one(is_obj & (node.n_keys < schema["minProperties"]), path, "minProperties"))
        for key in schema.get("required", []):
            parts.append(_one(is_obj & ~child(key).there, path, "required", key))
        for key, sub in props.items():
            c = child(key)
            sub_jpath = _child_path(jpath, key) if jpath is not None else None
            sub_err = _errors(sub, c, _lit_path(path, key), plan if sub_jpath else None, sub_jpath)
            parts.append(F.when(is_obj & c.there, sub_err).otherwise(_empty()))
        if "additionalProperties" in schema:
            ap = schema["additionalProperties"]
            known = F.array(*[F.lit(p) for p in props]) if props else F.array().cast("array<string>")
            if ap is False and jpath == "$":
                # a key is there or not, also with a null: more keys than listed ones found
                found = [child(p).there.cast("int") for p in props]
                parts.append(_one(is_obj & (node.n_keys > sum(found, F.lit(0))), path, "additionalProperties"))
            elif ap is False:
                # compiled, where map_filter is not
                extra_keys = F.array_except(F.map_keys(node.obj), known)
                parts.append(_one(is_obj & (F.size(extra_keys) > 0), path, "additionalProperties"))
            elif isinstance(ap, dict) and ap:
                extra = F.map_filter(node.obj, lambda key, _val: ~F.array_contains(known, key))
                per_extra = F.array_join(
                    F.transform(
                        F.map_entries(extra),
                        lambda e: _errors(ap, _Node(None, e["value"], ""), _lit_path(path, _escaped(e["key"])), None, None),
                    ), ""
                )
                parts.append(F.when(is_obj, per_extra).otherwise(_empty()))

    if "oneOf" in schema:
        n_ok = F.lit(0)
        for branch in schema["oneOf"]:
            n_ok = n_ok + F.when(_errors(branch, node, path, plan, jpath) == "", 1).otherwise(0)
        parts.append(_one(n_ok != 1, path, "oneOf"))
    for branch in schema.get("allOf", []):
        parts.append(_errors(branch, node, path, plan, jpath))
    if "if" in schema:
        cond_ok = _errors(schema["if"], node, path, plan, jpath) == ""
        if "then" in schema:
            parts.append(F.when(cond_ok, _errors(schema["then"], node, path, plan, jpath)).otherwise(_empty()))
        if "else" in schema:
            parts.append(F.when(~cond_ok, _errors(schema["else"], node, path, plan, jpath)).otherwise(_empty()))

    if not parts:
        return _empty()
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def errors(schema: dict[str, Any] | bool, v: Column, path: Column | None = None) -> Column:
    """Inline form (no staging): ARRAY<STRING> of errors of VARIANT ``v``."""
    return _listed(_errors(schema, _Node(None, v, ""), "" if path is None else path, None, None), _names_keys(schema))


_PLAN_CACHE: dict[tuple[str, str], RulePlan] = {}


def compile_rule(schema: dict[str, Any], payload: Column, cache_key: str | None = None) -> RulePlan:
    """Sorted error list for a whole payload (V-22), as a staged plan.

    Building a plan costs many JVM round trips, so plans are cached per
    (rule, payload column) when a ``cache_key`` is given. A cached plan must
    appear at most once in one DataFrame (its probe names are fixed).
    """
    if cache_key is None:
        return RulePlan(schema, payload)
    key = (cache_key, str(payload))
    if key not in _PLAN_CACHE:
        _PLAN_CACHE[key] = RulePlan(schema, payload)
    return _PLAN_CACHE[key]


def error_text(errs: Column) -> Column:
    """Errors as one ``;``-joined string (empty when valid)."""
    return F.array_join(errs, ";")
