"""Files whose schemas drift: their fields, the edit scripts between them, and one consistent table."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.skew import sharded_neighbour, skew_join
from loomstead.session import cut_lineage
from loomstead.sources.treeedit import STEP, Field, edit_script, field_tree, letters, name_distance, spot

#: Counts a task holds before it hands them on.
COUNTS_KEPT = 200_000
#: How far the name of a field may be from another one to share its column where no script shows the link.
ALIKE = 0.2


def _walk(value: object, path: str, out: Counter) -> None:
    if isinstance(value, dict):
        out[(path, "object", None)] += 1
        for k, v in value.items():
            _walk(v, f"{path}{STEP}{k}" if path else k, out)
    elif isinstance(value, list):
        out[(path, "array", None)] += 1
        for v in value:
            if isinstance(v, (dict, list)):
                _walk(v, f"{path}{STEP}[]", out)
    elif value is None:
        out[(path, "null", None)] += 1
    else:
        kind = "bool" if isinstance(value, bool) else "text" if isinstance(value, str) else "number"
        out[(path, kind, spot(value))] += 1


def field_values(df: DataFrame, file_keys: Sequence[str], payload: str) -> DataFrame:
    """(file keys, path, kind, spot, n): how often each field of each file holds each kind of JSON value, and about which one.

    spot is the place in a field's histogram, null where there is no plain value. Payloads are reduced to
    counts within each task, so what is shuffled is of the size of the schemas and histograms. A payload
    that is null or no JSON object counts under an empty path: (\"\", \"unreadable\"). Keys of nested objects
    are joined by the unit separator, elements of arrays are [].
    """
    source = df.select(*file_keys, F.col(payload).alias("__payload"))
    keys = [source.schema[k] for k in file_keys]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "path string, kind string, spot int, n bigint"])
    names = [*file_keys, "path", "kind", "spot", "n"]

    def reduce_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        types: list[pa.DataType] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*[(*k, n) for k, n in counts.items()]))
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(file_keys))] + [pa.string(), pa.string(), pa.int32(), pa.int64()]
            for *key, text in zip(*[c.to_pylist() for c in batch.columns]):
                own: Counter = Counter()
                try:
                    parsed = json.loads(text) if text is not None else None
                    if isinstance(parsed, dict):
                        _walk(parsed, "", own)
                except (ValueError, RecursionError):
                    parsed = None
                if isinstance(parsed, dict):
                    own.pop(("", "object", None), None)
                else:
                    own = Counter({("", "unreadable", None): 1})
                for cell, n in own.items():
                    counts[(*key, *cell)] += n
            if len(counts) > COUNTS_KEPT:
                yield packed()
        if counts:
            yield packed()

    return source.mapInArrow(reduce_batches, out).groupBy(*file_keys, "path", "kind", "spot").agg(F.sum("n").alias("n"))


def file_schemas(df: DataFrame, file_keys: Sequence[str], payload: str) -> DataFrame:
    """(file keys, fields): one row per file, its fields as array<struct<path, kinds, spots>> in order, as field_tree takes them."""
    found = field_values(df, file_keys, payload)
    counted = F.when(F.col("spot").isNotNull(), F.concat_ws(":", "spot", "n"))
    per_field = found.groupBy(*file_keys, "path").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("kind"))).alias("kinds"), F.concat_ws(",", F.array_sort(F.collect_list(counted))).alias("spots")
    )
    fields = F.filter(F.collect_list(F.struct("path", "kinds", "spots")), lambda c: c["path"] != "")
    return per_field.groupBy(*file_keys).agg(F.array_sort(fields).alias("fields"))


def _steps(files: DataFrame, series: str, sequence: str, file_id: str) -> DataFrame:
    """(series, sequence, file_id, prev_fields, fields): each file of a series with the one before it."""
    files = files.filter(F.col(series).isNotNull() & F.col(sequence).isNotNull())
    files = files.withColumn("__shard", F.floor(F.col(sequence) / 256).cast("long"))
    near = sharded_neighbour(files, [series], "__shard", [sequence, file_id], ["fields"])
    return near.filter(F.col("prev_fields").isNotNull()).select(series, sequence, file_id, "prev_fields", "fields")


def _tree(fields: list[dict]) -> Field:
    return field_tree((f["path"], f["kinds"], f["spots"]) for f in fields)


def _shape(fields: list[dict]) -> dict[str, str]:
    return {f["path"]: f["kinds"] for f in fields}


def _apart(files: DataFrame, steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, apart): the pairs of names of each step that could be one field, but stand side by side in some file.

    Only pairs that a step would gain from are looked up, in the different sets of fields that files have.
    """
    out = ", ".join([*(f"`{k}` {steps.schema[k].dataType.simpleString()}" for k in keys), "a string, b string"])

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *key, before, after in zip(*[c.to_pylist() for c in batch.columns]):
                pairs: set[tuple[str, str]] = set()
                old, new = _shape(before).keys(), _shape(after).keys()
                if old - new and new - old:
                    edit_script(_tree(before), _tree(after), likely=pairs)
                rows += [(*key, a, b) for a, b in sorted(pairs) if letters(a) != letters(b)]
            columns = list(zip(*rows)) or [[]] * (len(keys) + 2)
            types = [batch.schema.field(i).type for i in range(len(keys))] + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=[*keys, "a", "b"])

    asked = steps.mapInArrow(likely, out)
    sets = files.select(F.col("fields.path").alias("paths")).distinct()
    held = sets.select(F.xxhash64("paths").alias("set"), F.explode("paths").alias("path"))
    pairs = asked.select("a", "b").distinct()
    both = pairs.join(held.withColumnRenamed("path", "a"), "a").join(held.withColumnRenamed("path", "b"), ["set", "b"]).select("a", "b").distinct()
    return asked.join(both, ["a", "b"]).groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("apart"))


def edit_scripts(files: DataFrame, series: str, sequence: str, file_id: str) -> DataFrame:
    """(series, sequence, file_id, path, change_kind, old_path): the script of each file against the one before it in its series.

    Two names that stand side by side in any file of any series are two fields, however alike they are.
    """
    keys = [series, sequence, file_id]
    steps = cut_lineage(_steps(files, *keys))
    steps = steps.join(_apart(files, steps, keys), keys, "left").select(*keys, "prev_fields", "fields", "apart")
    out = ", ".join([*(f"`{k}` {steps.schema[k].dataType.simpleString()}" for k in keys), "path string, change_kind string, old_path string"])

    def diff(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *key, before, after, apart in zip(*[c.to_pylist() for c in batch.columns]):
                if _shape(before) == _shape(after):
                    continue
                script = edit_script(_tree(before), _tree(after), frozenset((p["a"], p["b"]) for p in apart or ()))[1]
                rows += [(*key, at, kind, was) for kind, at, was in script]
            columns = list(zip(*rows)) or [[]] * 6
            types = [batch.schema.field(i).type for i in range(3)] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=[*keys, "path", "change_kind", "old_path"])

    return steps.mapInArrow(diff, out)


def schema_changes(df: DataFrame, series: str, sequence: str, file_id: str, payload: str) -> DataFrame:
    """(file_id, field_name, change_kind, old_name): changes of each file against the one before it in its series.

    Nested fields are written with dots. Files are ordered by sequence, at equal numbers by file_id; the
    first file of a series has no changes. A file without a readable payload has no fields. A null series
    or sequence belongs to no series: such files are not compared.
    """
    dotted = lambda c: F.translate(c, "\x1f", ".")
    files = cut_lineage(file_schemas(df, [series, sequence, file_id], payload))
    return edit_scripts(files, series, sequence, file_id).select(
        F.col(file_id).cast("long").alias("file_id"), dotted("path").alias("field_name"), "change_kind", dotted("old_path").alias("old_name")
    ).distinct()


def unify_names(
    files_with: dict[str, int], renamed: Sequence[tuple[str, str, int]], apart: frozenset[tuple[str, str]] = frozenset(), prefer: Sequence[str] = ()
) -> dict[str, str]:
    """The path that stands for each path: names that the scripts of any series rename into each other are one field.

    Links are taken by falling number of steps that show them, then those between names of the same
    letters; a link that would bring two names of apart together is left out. A name that no script
    links joins the nearest one of its first letter and numbers within ALIKE, if one group alone is nearest.
    A preferred name stands for its group, else the one in most files, of these the lower-case, the
    longest, the least.
    """
    group = {p: {p} for p in files_with}
    cut = {*apart, *((b, a) for a, b in apart)}

    def free(a: str, b: str) -> bool:
        return a in group and b in group and group[a] is not group[b] and not any((i, j) in cut for i in group[a] for j in group[b])

    def link(a: str, b: str) -> None:
        if free(a, b):
            group[a] |= group[b]
            for p in group[b]:
                group[p] = group[a]

    for a, b, _ in sorted(renamed, key=lambda e: (-e[2], e[0], e[1])):
        link(a, b)
    shown = {p for a, b, _ in renamed for p in (a, b)}
    same, near = {}, {}
    for p in sorted(files_with):
        *above, own = map(letters, p.split(STEP))
        same.setdefault((*above, own), []).append(p)
        near.setdefault((*above, own[:1], *re.findall(r"\d+", own)), []).append(p)
    for ps in same.values():
        for p in ps[1:]:
            link(ps[0], p)
    last = lambda p: p.rsplit(STEP, 1)[-1]
    close = sorted((d, p, q) for ps in near.values() for p in ps if p not in shown for q in ps if p != q and (d := name_distance(last(p), last(q))) <= ALIKE)
    for d, p, q in close:
        if free(p, q) and all(group[r] is group[q] for e, o, r in close if o == p and e == d and free(p, r)):
            link(q, p)
    liked = {p: i for i, p in enumerate(prefer)}
    rank = lambda p: (liked.get(p, len(liked)), -files_with[p], p != p.lower(), -len(p), p)
    stands = {p: min(g, key=rank) for p, g in group.items()}

    def whole(path: str) -> str:
        at = ""
        for step in path.split(STEP):
            at = f"{at}{STEP}{step}" if at else step
            at = stands.get(at, at)
        return at

    return {p: whole(p) for p in files_with}


def column_names(files: DataFrame, scripts: DataFrame, prefer: Sequence[str] = ()) -> dict[str, str]:
    """The column of each path met in any file, nested ones with dots; what is gathered is of the size of the schemas."""
    sets = files.select(F.col("fields.path").alias("paths"))
    files_with = {r["path"]: r["n"] for r in sets.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
    links = scripts.filter("change_kind = 'renamed'").groupBy("path", "old_path").agg(F.count(F.lit(1)).alias("n"))
    renamed = [(r["old_path"], r["path"], r["n"]) for r in links.collect()]
    prefer = [p.replace(".", STEP) for p in prefer]
    files_with = {**dict.fromkeys(prefer, 0), **files_with}
    sets = cut_lineage(sets.distinct().select(F.xxhash64("paths").alias("set"), F.explode("paths").alias("path")))
    apart: frozenset[tuple[str, str]] = frozenset()
    while True:
        stands = unify_names(files_with, renamed, apart, prefer)
        members = Counter(stands.values())
        shared = [(p, s) for p, s in stands.items() if members[s] > 1]
        if not shared:
            break
        # two names of one group in one file are two fields after all; each turn tells at least one pair apart for good
        held = sets.join(files.sparkSession.createDataFrame(shared, "path string, stands string"), "path")
        other = held.select("set", "stands", F.col("path").alias("other"))
        clash = {(r["path"], r["other"]) for r in held.join(other, ["set", "stands"]).filter("path < other").select("path", "other").distinct().collect()}
        if clash <= apart:
            break
        apart |= clash
    columns: dict[str, str] = {}
    for path in sorted(set(stands.values()), key=lambda p: (p not in prefer, p)):
        name = ".".join(re.sub(r"[^\w\[\]]+", "_", x.strip().lower()) for x in path.split(STEP))
        while name in columns.values():
            name += "_2"
        columns[path] = name
    return {p: columns[s] for p, s in stands.items()}


def _stored(path: str, kinds: str) -> str | None:
    """The path whose column holds the values of a path: that of the outermost array around it; None for an object."""
    steps = path.split("\x1f")
    if "[]" in steps[1:]:
        return "\x1f".join(steps[: steps.index("[]", 1)])
    return None if kinds == "object" else path


class _Number(str):
    """A JSON number as it is written."""


def _json(value: object) -> str:
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in value.items()) + "}"
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def _values(value: dict, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of all that is not null: numbers as written, arrays as JSON."""
    for k, v in value.items():
        at = f"{path}\x1f{k}" if path else k
        if isinstance(v, dict) and "[]" not in v:
            yield from _values(v, at)
        elif v is not None and at:
            yield at, (str(v) if isinstance(v, str) else _json(v)).encode("utf-8", "replace").decode()


def _compose(scripts: DataFrame, names: dict[str, str], series: str, sequence: str, file_id: str) -> DataFrame:
    """(series, own, moves): the column that files before each move of a field put it in, with all later moves applied.

    Renaming keeps the column, so only moves change it. One backward pass a series over its moves.
    """
    moved = scripts.filter("change_kind = 'moved'").select(series, sequence, file_id, "path", "old_path")
    kinds = {k: moved.schema[k].dataType.simpleString() for k in (series, sequence, file_id)}
    out = f"`{series}` {kinds[series]}, own string, `{sequence}` {kinds[sequence]}, `{file_id}` {kinds[file_id]}, target string"

    def backward(moves: pa.Table) -> pa.Table:
        by_file: dict = {}
        for s, n, f, new, old in zip(*[c.to_pylist() for c in moves.columns]):
            if _stored(new, "") == new and _stored(old, "") == old:
                by_file.setdefault((n, f), []).append((s, names[old], names[new]))
        final: dict[str, str] = {}
        rows = []
        for n, f in sorted(by_file, reverse=True):
            step = {old: final.get(new, new) for _, old, new in by_file[n, f]}
            rows += [(s, old, n, f, step[old]) for s, old, _ in by_file[n, f]]
            final |= step
        types = [moves.schema.field(0).type, pa.string(), moves.schema.field(1).type, moves.schema.field(2).type, pa.string()]
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=[series, "own", sequence, file_id, "target"])

    steps = moved.groupBy(series).applyInArrow(backward, out)
    return steps.groupBy(series, "own").agg(F.array_sort(F.collect_list(F.struct(F.struct(sequence, file_id).alias("at"), "target"))).alias("moves"))


def column_maps(files: DataFrame, scripts: DataFrame, names: dict[str, str], series: str, sequence: str, file_id: str) -> DataFrame:
    """(series, sequence, file_id, own, target): the column of each field of each file, by all scripts after it in its series.

    own is the column by the field's name alone. If a file holds another field in the column that a move
    leads to, the moved field stays in its own, so no two fields of a file are ever merged.
    """
    keys = [series, sequence, file_id]
    fields = files.select(*keys, F.explode("fields").alias("c")).select(*keys, "c.path", "c.kinds")
    out = ", ".join([*(f"`{k}` {fields.schema[k].dataType.simpleString()}" for k in keys), "own string"])

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(p := _stored(path, kinds)) and names[p] for path, kinds in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(own, type=pa.string())], names=[*keys, "own"])

    fields = fields.mapInArrow(named, out).filter("own is not null").distinct()
    moves = _compose(scripts, names, *keys)
    here = F.struct(F.col(sequence), F.col(file_id))
    later = F.get(F.filter("moves", lambda m: m["at"] > here), F.lit(0))["target"]
    fields = fields.join(moves, [series, "own"], "left").withColumn("target", F.coalesce(later, "own"))
    of_file = fields.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("own", "target"))).alias("pairs"))
    taken = F.transform(F.filter("pairs", lambda p: p["own"] == p["target"]), lambda p: p["own"])
    of_file = of_file.withColumn("taken", taken).withColumn("moved", F.filter("pairs", lambda p: p["own"] != p["target"]))
    first = lambda p: F.filter("moved", lambda q: q["target"] == p["target"])[0]["own"]
    kept = F.transform("pairs", lambda p: F.struct(p["own"].alias("own"), F.when((p["own"] == p["target"]) | F.array_contains("taken", p["target"]) | (first(p) != p["own"]), p["own"]).otherwise(p["target"]).alias("target")))
    return of_file.select(*keys, F.explode(kept).alias("p")).select(*keys, "p.own", "p.target")


def series_table(
    df: DataFrame, keys: Sequence[str], series: str, sequence: str, file_id: str, payload: str,
    wanted: dict[str, Callable[[Column], Column]], other: Callable[[str], Callable[[Column], Column]],
) -> DataFrame:
    """One consistent table of all files: the scripts of all series are compiled into a projection that every file goes through.

    Names that scripts rename into each other share a column over all series; moves are composed along
    each series, so a field is in the column of its last place, nested ones with dots; an array is one
    column of JSON text. Columns of wanted are always there and come first, typed as said; all others that
    any file has follow by name, typed by other. Of one field twice in a row the first value that is not
    null counts; two fields of a file never share a column. Unreadable payloads give nulls. A column named
    as one of keys gets the prefix payload_.
    """
    at = [series, sequence, file_id]
    files = cut_lineage(file_schemas(df, at, payload))
    scripts = cut_lineage(edit_scripts(files, *at))
    names = column_names(files, scripts, list(wanted))
    maps = cut_lineage(column_maps(files, scripts, names, *at))
    # the columns of all files: schema-sized, whatever the rows
    columns = sorted({*wanted, *(r["target"] for r in maps.select("target").distinct().collect())})
    moved = maps.filter("own != target").groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("own", "target"))).alias("__moved"))
    moved = moved.join(df.groupBy(*at).agg(F.count(F.lit(1)).alias("__n")), at)
    rows = skew_join(df.select(*dict.fromkeys([*keys, *at]), F.col(payload).alias("__payload")), moved, at, "__n", [payload if payload in keys else "__payload"])
    rows = rows.select(*keys, "__moved", "__payload")
    place = {c: i for i, c in enumerate(columns)}
    out = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), *(f"c{i} string" for i in place.values())])

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[tuple, dict[str, int]] = {}

        def projection(moves: tuple) -> dict[str, int]:
            if moves not in compiled:
                to = dict(moves)
                compiled[moves] = {path: place[c] for path, own in names.items() if (c := to.get(own, own)) in place}
            return compiled[moves]

        for batch in batches:
            data = [[None] * batch.num_rows for _ in columns]
            for i, (moves, text) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                try:
                    parsed = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number) if text is not None else None
                    found = sorted(_values(parsed)) if isinstance(parsed, dict) else []
                except (ValueError, RecursionError):
                    continue
                to = projection(tuple(moves or ()))
                for path, value in found:
                    cells = data[to[path]]
                    if cells[i] is None:
                        cells[i] = value
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keys))), *(pa.array(c, type=pa.string()) for c in data)], names=[*keys, *(f"c{i}" for i in place.values())]
            )

    taken = {k.lower() for k in keys}
    typed = {**wanted, **{c: other(c) for c in columns if c not in wanted}}
    return rows.mapInArrow(project, out).select(*keys, *[f(F.col(f"c{place[c]}")).alias(f"payload_{c}" if c in taken else c) for c, f in typed.items()])


def number_text(c: Column) -> Column:
    """Double of a text that may carry blanks and a percent sign; null if no plain number remains."""
    return F.regexp_replace(c, r"^\s+|\s*%?\s*$", "").try_cast("double")
