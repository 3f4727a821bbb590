"""Reading untrusted JSON held as VARIANT: candidate paths, array discovery by shape, scattered text.

Every function is an expression over one document, so a page of results is taken apart in the task that read it,
without a shuffle. Objects in a VARIANT keep their keys sorted: "document order" below means list positions as
written and object members by key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.functions.text import bind, sql_text

_STEP = re.compile(r"([^.\[\]]*)(?:\[(\d+)\])?$")
_NODES = "cast(array() as array<struct<d:int,p:array<int>,k:string,v:variant>>)"


def _json_path(path: str) -> str:
    out = "$"
    for segment in path.split("."):
        key, index = _STEP.match(segment).groups()
        out += (f"['{key}']" if key else "") + (f"[{index}]" if index is not None else "")
    return out


def dig(doc: str, path: str, as_type: str = "variant") -> str:
    """SQL for a dotted path with ``[i]``; what follows a ``[*]`` is ignored, the array itself is meant."""
    head = path.split("[*]")[0]
    return f"try_variant_get({doc}, {sql_text(_json_path(head))}, '{as_type}')"


def items_of(node: str) -> str:
    return f"try_variant_get({node}, '$', 'array<variant>')"


def members_of(node: str) -> str:
    return f"try_variant_get({node}, '$', 'map<string,variant>')"


def _bound(value: str, then: str) -> str:
    """SQL for ``then`` over the lambda variable v, with the value worked out once."""
    return f"get(transform(array({value}), v -> {then}), 0)"


def scalar_text(doc: str, path: str) -> str:
    """SQL for a scalar at ``path`` as text; objects, arrays and blanks count as not said."""
    text = _bound("trim(try_variant_get(v, '$', 'string'))", "if(v <> '', v, null)")
    return _bound(dig(doc, path), f"if(v is null or schema_of_variant(v) rlike '^(OBJECT|ARRAY|VOID)', null, {text})")


def string_only(doc: str, path: str) -> str:
    return _bound(dig(doc, path), "if(schema_of_variant(v) = 'STRING', try_variant_get(v, '$', 'string'), null)")


def first_text(doc: str, paths) -> Column:
    """The first path that holds a usable scalar, as text."""
    return F.expr(f"coalesce({', '.join([scalar_text(doc, p) for p in paths] + ['cast(null as string)'])})")


def first_parsed(doc: str, paths, from_text, from_number) -> Column:
    """First candidate that survives its parser; a failed parse falls through to the next path."""
    def parsed(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return F.when(v.isNull(), None).when(kind == "STRING", from_text(F.try_variant_get(v, "$", "string"))).when(
            kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"), from_number(F.try_variant_get(v, "$", "double")))

    cases = [bind(F.expr(dig(doc, p)), parsed) for p in paths]
    return F.coalesce(*cases) if cases else F.lit(None).cast("double")


def ordered_union(items: Column, limit: int | None = None) -> Column:
    """Distinct strings in order of first appearance, compared without case."""
    lowered = F.transform(items, lambda x: F.lower(x))
    firsts = F.array_distinct(lowered)
    kept = F.transform(firsts, lambda x: F.get(items, (F.array_position(lowered, x) - 1).cast("int")))
    return F.slice(kept, 1, limit) if limit else kept


#: The JSON parser refuses deeper documents than 1,000 levels. A loop copies all it has found at every step, also where the
#: document has ended, so few levels are counted through first and the next number only where these have not ended it.
_LEVELS = (6, 14, 80, 900)


def _walk(start: str, descend: str, depth: int | None = None, list_limit: int | None = None) -> str:
    """SQL array of all nodes under ``start``: below the start d, path p, member name k, value v. ``descend`` says for
    a node ``x`` whether its children are visited. Only the newest level is looked at for children."""
    items = items_of("x.v")
    items = f"slice({items}, 1, {list_limit})" if list_limit else items
    children = (
        f"coalesce(transform({items}, i -> named_struct('key', '', 'value', i)), "
        f"map_entries({members_of('x.v')}), cast(array() as array<struct<key:string,value:variant>>))"
    )
    child = "named_struct('d', 1, 'p', concat(x.p, array(i)), 'k', c.key, 'v', c.value)"
    newer = f"flatten(transform(filter(acc.front, x -> {descend}), x -> transform({children}, (c, i) -> {child})))"
    step = _bound(newer, "named_struct('front', v, 'found', concat(acc.found, v))")

    def levels(n, begin: str) -> str:
        return f"aggregate(sequence(1, {n}), {begin}, (acc, d) -> if(size(acc.front) = 0, acc, {step}))"

    begin = _bound(f"concat({_NODES}, {start})", "named_struct('front', v, 'found', v)")
    if depth:
        return f"{levels(depth, begin)}.found"
    counts = ", ".join(map(str, _LEVELS))
    return f"aggregate(array({counts}), {begin}, (w, n) -> if(size(w.front) = 0, w, {levels('n', 'w')})).found"


def _label(node: str) -> str:
    return f"coalesce({', '.join(string_only(node, k) for k in fv.LABEL_KEYS)})"


def _scalar(node: str) -> str:
    plain = f"try_variant_get({node}, '$', 'string')"
    return (
        f"case when schema_of_variant({node}) rlike '^(OBJECT|ARRAY|VOID)' then null "
        f"when schema_of_variant({node}) = 'BOOLEAN' then initcap({plain}) else {plain} end"
    )


def _strings(start: str) -> str:
    """SQL array of the strings under the start nodes. An object with a label stands for it and is not entered."""
    nodes = _walk(start, f"{_label('x.v')} is null")
    pairs = f"transform({nodes}, n -> named_struct('p', n.p, 's', coalesce({_label('n.v')}, {_scalar('n.v')})))"
    return f"transform(array_sort(filter({pairs}, n -> n.s is not null)), n -> n.s)"


def collect_strings(doc: str, paths, limit: int | None = None) -> Column:
    """Strings found at any of the paths, in order, each once."""
    if not paths:
        return F.array().cast("array<string>")
    starts = ", ".join(f"named_struct('d', 0, 'p', array({i}), 'k', '', 'v', {dig(doc, p)})" for i, p in enumerate(paths))
    found = _strings(f"filter(array({starts}), n -> n.v is not null)")
    return ordered_union(F.expr(f"filter(transform({found}, s -> trim(s)), s -> s <> '')"), limit)


def scattered_text(doc: str, names, limit: int | None = None, depth: int | None = None,
                   list_limit: int | None = None) -> Column:
    """Every string under a member with one of the names, anywhere in the document, as one text. The limits (characters,
    levels, items of a list) are off unless given."""
    if not names:
        return F.lit(None).cast("string")
    wanted = "lower(x.k) in (" + ", ".join(sql_text(n.lower()) for n in names) + ")"
    root = f"array(named_struct('d', 0, 'p', cast(array() as array<int>), 'k', '', 'v', {doc}))"
    nodes = _walk(root, f"not ({wanted})", depth, list_limit)
    below = _strings("array(named_struct('d', 0, 'p', array(0), 'k', '', 'v', x.v))")
    hits = f"transform(filter({nodes}, x -> x.d > 0 and {wanted}), x -> named_struct('p', x.p, 's', {below}))"
    texts = f"filter(array_distinct(flatten(transform(array_sort({hits}), x -> x.s))), s -> s <> '')"
    joined = f"array_join({texts}, ' . ')"
    return F.expr(f"nullif({f'left({joined}, {limit})' if limit else joined}, '')")


def find_result_array_sql(doc: str, min_signals: int = 2, depth: int | None = None, list_limit: int | None = None,
                          probed: int | None = None) -> str:
    """``depth``, ``list_limit`` and ``probed`` (objects of an array that are looked at) are off unless given."""
    signals = "array(" + ", ".join(sql_text(s) for s in fv.LISTING_SIGNALS) + ")"
    names = f"transform(map_keys({members_of('o')}), k -> lower(k))"
    looks_right = f"size(array_intersect({names}, {signals})) >= {min_signals}"
    root = f"array(named_struct('d', 0, 'p', cast(array() as array<int>), 'k', '', 'v', {doc}))"
    nodes = _walk(root, "true", depth, list_limit)
    objects = f"filter({items_of('n.v')}, o -> {members_of('o')} is not null)"
    lists = f"transform({nodes}, n -> named_struct('p', n.p, 'o', coalesce({objects}, cast(array() as array<variant>))))"
    fitting = f"filter({lists}, l -> exists({f'slice(l.o, 1, {probed})' if probed else 'l.o'}, o -> {looks_right}))"
    none = "named_struct('p', cast(null as array<int>), 'o', cast(array() as array<variant>))"
    better = "size(l.o) > size(acc.o) or (size(l.o) = size(acc.o) and l.p < acc.p)"
    return f"aggregate({fitting}, {none}, (acc, l) -> if({better}, l, acc)).o"


def find_result_array(doc: str, min_signals: int = 2) -> Column:
    """The largest array in the document whose objects look like listings; the earliest of equals; else empty."""
    return F.expr(find_result_array_sql(doc, min_signals))


def objects_in(array_sql: str) -> str:
    return f"filter({array_sql}, o -> {members_of('o')} is not null)"


def enveloped_records(doc: str) -> Column:
    """Records out of an unknown envelope: a bare array, a named member, one member deeper, else by shape."""
    named = []
    for key in fv.ENVELOPE_KEYS:
        named.append(items_of(dig(doc, key)))
        named += [items_of(dig(doc, f"{key}.{k}")) for k in fv.NESTED_ENVELOPE_KEYS]
    usable = ", ".join(f"if(size({a}) > 0, {objects_in(a)}, null)" for a in named)
    direct = F.expr(f"coalesce({objects_in(items_of(doc))}, {usable})")
    return F.coalesce(direct, find_result_array(doc))


def as_objects(doc: str) -> str:
    """SQL array of objects for a value that is one object or an array of them."""
    return f"coalesce({objects_in(items_of(doc))}, if({members_of(doc)} is not null, array({doc}), null))"


def pick(doc: str, *names: str) -> str:
    """SQL for the first member that says something, exact spelling before any other casing; as text."""
    exact = [scalar_text(doc, n) for n in names]
    folded = [
        f"nullif(trim(try_variant_get(get(filter(map_entries({members_of(doc)}), e -> lower(e.key) = {sql_text(n.lower())}), 0).value, '$', 'string')), '')"
        for n in names
    ]
    return f"coalesce({', '.join(exact + folded)})"
