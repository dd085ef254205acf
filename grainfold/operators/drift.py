"""Schemas that drift between the files of a feed: changes, and one consistent table.

Every record is flattened to its paths with their JSON types and values. The schema of a file is a
tree of paths; between a file and the one before it, a tree edit script of least cost turns the old
tree into the new one: keeping a node is free, changing its types costs 1, renaming it costs 1 and
needs equal values as evidence, removing or adding a subtree costs its number of nodes. Children are
matched under matched parents only, level by level, by a minimum-cost assignment. For the projection
the script also has moves to another parent, on the same evidence and at the cost of a rename; the
listed changes report those as removed and added. The scripts of all files compile into a projection
that carries each record through the later renames and moves of its feed.

The table has one form for all feeds: a place is the names down to it, and a place has one type in
every record. Where some values are arrays, all become arrays (nested as deep as the deepest); where
some are objects, every other value becomes an object that holds it in one member, the one of which
the values agree most often with the plain ones of the same concept, or ``value`` where none do; other
mixed places become strings. Nothing is left out by this.

Defined cases: lines that are no JSON, or no JSON object, are ignored; a file of which no line is
left has an empty schema. Null members count as absent. Names are case-sensitive. Of members named
twice in one object the last counts. Repeated lines count once. A record without ``concept`` belongs
to the concept NULL and gives no evidence. A feed's first file has no changes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfold.plans.runtime import cut, ensure_checkpoint_dir, spread

TYPE_BITS = {"string": 1, "number": 2, "boolean": 4, "object": 8, "array": 16}


def refuse(name: str) -> None:
    raise ValueError(name)


def load(line: str | None) -> dict | None:
    """The object of a line, or None."""
    try:
        found = json.loads(line, parse_constant=refuse) if line else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def type_of(v: object) -> str | None:
    if v is None:
        return None
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def plain(v: object) -> object:
    """Equal numbers written alike, null members left out."""
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items() if x is not None}
    return [plain(x) for x in v] if isinstance(v, list) else v


def flatten(v: object, path: str, out: dict[str, tuple[int, list]]) -> None:
    """Type bits and values, in order, of every path below."""
    t = type_of(v)
    if t is None:
        return
    if path:
        bits, values = out.get(path, (0, []))
        values.append(v)
        out[path] = (bits | TYPE_BITS[t], values)
    if t == "object":
        for k, x in v.items():
            flatten(x, f"{path}.{k}" if path else k, out)
    elif t == "array":
        for x in v:
            flatten(x, f"{path}[]", out)


def paths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feed, file, concept, path, types, value) of every path of every record."""
    for batch in batches:
        rows = []
        for feed, file, line in zip(*(c.to_pylist() for c in batch.columns)):
            record = load(line)
            if record is None:
                continue
            found: dict[str, tuple[int, list]] = {}
            flatten(record, "", found)
            concept = record.get("concept")
            concept = concept if concept is None or isinstance(concept, str) else json.dumps(concept, sort_keys=True)
            rows += [(feed, file, concept, p, bits, json.dumps(plain(values), sort_keys=True, ensure_ascii=False)) for p, (bits, values) in found.items()]
        cols = list(zip(*rows)) or [[]] * 6
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["feed", "file", "concept", "path", "types", "value"])


def parent_of(path: str) -> str:
    return path[:-2] if path.endswith("[]") else path.rpartition(".")[0]


Tree = dict[str, tuple[int, list[str]]]


def tree_of(nodes: list[tuple[str, int]]) -> Tree:
    """Types and children of every path; the root is ''."""
    tree: Tree = {"": (0, [])} | {p: (t, []) for p, t in sorted(nodes)}
    for p in list(tree):
        if p:
            # A dot may belong to a name: the parent is the longest path that exists.
            up = parent_of(p)
            while up not in tree:
                up = parent_of(up)
            tree[up][1].append(p)
    return tree


def nodes_below(tree: Tree, path: str) -> int:
    return 1 + sum(nodes_below(tree, c) for c in tree[path][1])


def assignment(cost: list[list[float]]) -> list[int]:
    """Row of least total cost for each column of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    inf = float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [match[j] - 1 for j in range(1, n + 1)]


def matching(old: Tree, new: Tree, gone: list[str], come: list[str], evidence: set[tuple[str, str]]) -> dict[str, str]:
    """Which paths of ``gone`` live on as one of ``come``, so that the whole costs least."""
    matched: dict[str, str] = {}
    if gone and come and any((p, q) in evidence for p in gone for q in come):
        n = len(gone) + len(come)
        forbidden = 1e9
        # Rows: old nodes, then additions; columns: new nodes, then removals.
        cost = [[forbidden] * n for _ in range(n)]
        for i in range(n):
            for j in range(n):
                if i < len(gone) and j < len(come):
                    if (gone[i], come[j]) in evidence and old[gone[i]][0] == new[come[j]][0]:
                        cost[i][j] = 1.0
                elif i < len(gone):
                    cost[i][j] = float(nodes_below(old, gone[i])) if j - len(come) == i else forbidden
                elif j < len(come):
                    cost[i][j] = float(nodes_below(new, come[j])) if i - len(gone) == j else forbidden
                else:
                    cost[i][j] = 0.0
        for j, i in enumerate(assignment(cost)):
            if j < len(come) and i < len(gone) and cost[i][j] == 1.0:
                matched[gone[i]] = come[j]
    return matched


def edit_script(old: Tree, new: Tree, evidence: set[tuple[str, str]], a: str = "", b: str = "") -> list[tuple[str, str, str]]:
    """(path, kind, new path) of the cheapest script below the matched nodes a and b; nothing below a reported path."""
    out = []
    left, right = old[a][1], new[b][1]
    both = set(left) & set(right)
    for p in sorted(both):
        if old[p][0] != new[p][0]:
            out.append((p, "retyped", ""))
        else:
            out += edit_script(old, new, evidence, p, p)
    gone, come = [p for p in left if p not in both], [p for p in right if p not in both]
    matched = matching(old, new, gone, come, evidence)
    out += [(p, "renamed", matched[p]) if p in matched else (p, "removed", "") for p in gone]
    return out + [(q, "added", "") for q in come if q not in matched.values()]


def below(path: str, above: str) -> bool:
    return path == above or path.startswith((f"{above}.", f"{above}[]"))


def arrays_of(path: str) -> str:
    """The path down to the innermost array element it stands in."""
    return path[: path.rfind("[]") + 2] if "[]" in path else ""


def moves(old: Tree, new: Tree, evidence: set[tuple[str, str]], renames: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(path once the renames are done, 'moved', new path) of what goes on under another parent, outermost first."""

    def now_at(p: str) -> str:
        return next((q + p[len(r) :] for r, q in renames if below(p, r)), p)

    kept = {now_at(p) for p in old}
    # Of a pair only one end may be free: an element is no place of its own, and what has gone on elsewhere stays there.
    gone = [p for p in old if p and now_at(p) not in new and any(p == a for a, _ in evidence)]
    come = [q for q in new if q and q not in kept and any(q == b for _, b in evidence)]
    fits = {(p, q) for p, q in evidence if arrays_of(now_at(p)) == arrays_of(q) and not q.endswith("[]")}
    out: list[tuple[str, str, str]] = []
    for p, q in sorted(matching(old, new, gone, come, fits).items()):
        if not any(below(now_at(p), a) or below(q, b) for a, _, b in out):
            out.append((now_at(p), "moved", q))
    return out


def candidates(moving: bool):
    """(feed, file, before, path, new_path): a path that goes and one of the same types that comes, under the same parent or, if ``moving``, any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return candidate_rows(batches, moving)

    return run


def candidate_rows(batches: Iterator[pa.RecordBatch], moving: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for feed, file, before, old, new in zip(*(c.to_pylist() for c in batch.columns)):
            was, now = ({x["path"]: x["types"] for x in s or []} for s in (old, new))
            came = [q for q in now if q not in was]
            rows += [(feed, file, before, p, q) for p in was if p not in now for q in came if (moving or parent_of(p) == parent_of(q)) and was[p] == now[q] and p[-2:] != "[]"]
        cols = list(zip(*rows)) or [[]] * 5
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["feed", "file", "before", "path", "new_path"])


def scripts(moving: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return script_rows(batches, moving)

    return run


def script_rows(batches: Iterator[pa.RecordBatch], moving: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for feed, file, old, new, proof in zip(*(c.to_pylist() for c in batch.columns)):
            was, now = (tree_of([(x["path"], x["types"]) for x in s or []]) for s in (old, new))
            evidence = {(x["path"], x["new_path"]) for x in proof or []}
            edits = edit_script(was, now, {(p, q) for p, q in evidence if parent_of(p) == parent_of(q)})
            if moving:
                edits += moves(was, now, evidence, [(p, q) for p, kind, q in edits if kind == "renamed"])
            rows += [(feed, file, *edit) for edit in edits]
        cols = list(zip(*rows)) or [[]] * 5
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["feed_id", "file_no", "field_path", "change_kind", "new_path"])


def records(df: DataFrame) -> DataFrame:
    """(feed, file, line) of the raw rows."""
    return df.select(F.col("feed_id").cast("string").alias("feed"), F.col("file_no").cast("int").alias("file"), F.col("raw_json").cast("string").alias("line"))


def changes(df: DataFrame, moving: bool = False) -> DataFrame:
    """(feed_id, file_no, field_path, change_kind, new_path) between each file of a feed and the one before it.

    With ``moving`` there are also rows of kind moved, besides the removal and the addition they stand for.
    """
    raw = records(df).where(F.col("feed").isNotNull() & F.col("file").isNotNull())
    flat = cut(spread(raw).mapInArrow(paths_of, "feed string, file int, concept string, path string, types int, value string"))
    # One row a file; the number of its distinct paths is that of its layout.
    per_path = flat.groupBy("feed", "file", "path").agg(F.bit_or("types").alias("types"))
    schemas = per_path.groupBy("feed", "file").agg(F.collect_list(F.struct("path", "types")).alias("schema"))
    files = raw.select("feed", "file").distinct().join(schemas, ["feed", "file"], "left")
    order = Window.partitionBy("feed").orderBy("file")
    pairs = cut(files.select("feed", "file", F.lag("file").over(order).alias("before"), F.lag("schema").over(order).alias("old"), F.col("schema").alias("new")).where(F.col("before").isNotNull()))
    maybe = pairs.select("feed", "file", "before", "old", "new").mapInArrow(candidates(moving), "feed string, file int, before int, path string, new_path string")
    values = flat.where(F.col("concept").isNotNull()).select("feed", "file", "concept", "path", "value").groupBy("feed", "file", "concept", "path").agg(F.min("value").alias("value"))
    was = values.select("feed", F.col("file").alias("before"), "concept", "path", F.col("value").alias("old_value"))
    now = values.select("feed", "file", "concept", F.col("path").alias("new_path"), F.col("value").alias("new_value"))
    seen = maybe.join(was, ["feed", "before", "path"]).join(now, ["feed", "file", "concept", "new_path"])
    proof = seen.groupBy("feed", "file", "path", "new_path").agg(F.count("*").alias("n"), F.bool_and(F.col("old_value") == F.col("new_value")).alias("alike")).where("n >= 2 and alike")
    proof = proof.groupBy("feed", "file").agg(F.collect_list(F.struct("path", "new_path")).alias("proof"))
    judged = pairs.join(proof, ["feed", "file"], "left").select("feed", "file", "old", "new", "proof")
    return judged.mapInArrow(scripts(moving), "feed_id string, file_no int, field_path string, change_kind string, new_path string")


def renamed_record(v: object, path: str, names: dict[str, str]) -> object:
    """The value with its members under their new names; a member whose new name is taken keeps its own."""
    if isinstance(v, dict):
        out = {}
        for k, x in v.items():
            if x is not None:
                p = f"{path}.{k}" if path else k
                name = names[p].removeprefix(f"{parent_of(p)}.") if p in names else k
                out[k if name != k and v.get(name) is not None else name] = renamed_record(x, p, names)
        return out
    return [renamed_record(x, f"{path}[]", names) for x in v] if isinstance(v, list) else v


def take(v: dict, path: str) -> tuple[dict, str] | None:
    """The object that holds a path of members, and its name there."""
    if v.get(path) is not None:
        return v, path
    at = path.find(".")
    while at >= 0:
        inner = v.get(path[:at])
        if isinstance(inner, dict) and (found := take(inner, path[at + 1 :])):
            return found
        at = path.find(".", at + 1)
    return None


def move(v: object, path: str, new_path: str) -> None:
    """Take what stands at a path to another one, if that place is free and what is above it can hold it."""
    if isinstance(v, list):
        for x in v:
            move(x, path, new_path)
    elif isinstance(v, dict) and "[]" in path:
        above, _, rest = path.partition("[]")
        if found := take(v, above):
            inner = found[0][found[1]]
            for x in inner if isinstance(inner, list) else []:
                move(x, rest.removeprefix("."), new_path[len(above) + 2 :].removeprefix("."))
    elif isinstance(v, dict) and (found := take(v, path)) and not take(v, new_path):
        *above, name = new_path.split(".")
        to = v
        for k in above:
            to = to.get(k) if to.get(k) is not None else {}
            if not isinstance(to, dict):
                return
        to = v
        for k in above:
            if to.get(k) is None:
                to[k] = {}
            to = to[k]
        to[name] = found[0].pop(found[1])
        # An object that held nothing else goes with it.
        while not found[0] and "." in path:
            path = path.rpartition(".")[0]
            if not (found := take(v, path)):
                break
            del found[0][found[1]]


Step = tuple[dict[str, str], list[tuple[str, str]]]


def compiled(edits: str | None, file: int | None) -> list[Step]:
    """The projection of one file: the renames and moves of each later file of its feed, in order, from JSON [file, path, kind, new path]."""
    steps: dict[int, Step] = {}
    for n, path, kind, new_path in json.loads(edits) if edits else []:
        if file is not None and (n := int(n)) > file:
            renames, moves_ = steps.setdefault(n, ({}, []))
            if kind == "renamed":
                renames[path] = new_path
            else:
                moves_.append((path, new_path))
    return [(renames, sorted(moves_)) for _, (renames, moves_) in sorted(steps.items())]


def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carry each record through the projection of its file, which is compiled once for all records of the file."""
    known: dict[tuple[str | None, int | None], list[Step]] = {}
    for batch in batches:
        rows = []
        edits = batch.column(4).dictionary_encode()
        scripts_ = edits.dictionary.to_pylist()
        for raw_id, feed, file, line, at in zip(*(c.to_pylist() for c in batch.columns[:4]), edits.indices.to_pylist()):
            record = load(line)
            if record is None:
                continue
            script = None if at is None else scripts_[at]
            if (script, file) not in known:
                if len(known) > 10_000:
                    known.clear()
                known[script, file] = compiled(script, file)
            record = renamed_record(record, "", {})
            for renames, moves_ in known[script, file]:
                if renames:
                    record = renamed_record(record, "", renames)
                for path, new_path in moves_:
                    move(record, path, new_path)
            rows.append((raw_id, feed, file, json.dumps(record, ensure_ascii=False)))
        cols = list(zip(*rows)) or [[]] * 4
        types = [batch.schema.types[0], pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["raw_id", "feed", "file", "line"])


def places(v: object, place: tuple[str, ...], depth: int, out: dict[tuple[str, ...], list]) -> None:
    """Of every place below: type bits without arrays, depth of arrays, plain values."""
    t = type_of(v)
    if t is None:
        return
    found = out.setdefault(place, [0, 0, set()])
    if t == "array":
        found[1] = max(found[1], depth + 1)
        for x in v:
            places(x, place, depth + 1, out)
        return
    found[0] |= TYPE_BITS[t]
    if t == "object":
        for k, x in v.items():
            places(x, (*place, k), 0, out)
    else:
        found[2].add(json.dumps(plain(v), ensure_ascii=False))


def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feed, concept, top, place, above, member, types, depth, values) of every place of every record; place and above are JSON arrays of names."""
    for batch in batches:
        rows = []
        for feed, line in zip(*(c.to_pylist() for c in batch.columns)):
            record = json.loads(line)
            found: dict[tuple[str, ...], list] = {}
            for k, x in record.items():
                places(x, (k,), 0, found)
            concept = json.dumps(record.get("concept"), sort_keys=True)
            rows += [(feed, concept, p[0], json.dumps(p), json.dumps(p[:-1]), p[-1], bits, depth, sorted(values)) for p, (bits, depth, values) in found.items()]
        cols = list(zip(*rows)) or [[]] * 9
        types = [pa.string()] * 6 + [pa.int32(), pa.int32(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["feed", "concept", "top", "place", "above", "member", "types", "depth", "values"])


PLAIN = TYPE_BITS["string"] | TYPE_BITS["number"] | TYPE_BITS["boolean"]


def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(top, form) of each top-level field: the form of every place below it, as JSON [place, [kind, depth, member]]."""
    for batch in batches:
        rows = []
        for top, found in zip(*(c.to_pylist() for c in batch.columns)):
            bits = {tuple(json.loads(x["place"])): x["types"] for x in found}
            depth = {tuple(json.loads(x["place"])): x["depth"] for x in found}
            member = {tuple(json.loads(x["place"])): x["member"] or "value" for x in found}
            form, open_ = [], sorted(bits, key=len, reverse=True)
            while open_:
                p = open_.pop()
                b = bits[p]
                if b & TYPE_BITS["object"]:
                    kind = "object"
                    if b & PLAIN:
                        m = (*p, member[p])
                        if m not in bits:
                            # It stands below p, so it is looked at later.
                            bits[m], depth[m], member[m] = 0, 0, "value"
                            open_.append(m)
                            open_.sort(key=len, reverse=True)
                        bits[m] |= b & PLAIN
                else:
                    kind = next((k for k, bit in TYPE_BITS.items() if b == bit), "string")
                form.append([p, [kind, depth[p], member.get(p, "value")]])
            rows.append((top, json.dumps(form)))
        cols = list(zip(*rows)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["top", "form"])


def formed(v: object, place: tuple[str, ...], form: dict[tuple[str, ...], list], depth: int | None = None) -> object:
    """The value in the form of its place."""
    if v is None:
        return None
    kind, deep, member = form[place]
    depth = deep if depth is None else depth
    if isinstance(v, list):
        return [formed(x, place, form, depth - 1) for x in v]
    if depth:
        return [formed(v, place, form, depth - 1)]
    if isinstance(v, dict):
        return {k: formed(x, (*place, k), form) for k, x in v.items() if x is not None}
    if kind == "object":
        return {member: formed(v, (*place, member), form)}
    return json.dumps(v) if kind == "string" and not isinstance(v, str) else v


def unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bring each projected record into the form of the table."""
    known: dict[str, dict] = {}
    for batch in batches:
        rows = []
        for raw_id, feed, file, line, given in zip(*(c.to_pylist() for c in batch.columns)):
            form: dict[tuple[str, ...], list] = {}
            for one in given or []:
                if one not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[one] = {tuple(p): f for p, f in json.loads(one)}
                form |= known[one]
            now = {k: formed(v, (k,), form) for k, v in json.loads(line).items() if v is not None}
            concept = now.get("concept")
            rows.append((raw_id, feed, file, concept if isinstance(concept, str) or concept is None else json.dumps(concept), json.dumps(now, sort_keys=True, ensure_ascii=False)))
        cols = list(zip(*rows)) or [[]] * 5
        types = [batch.schema.types[0], pa.string(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["raw_id", "feed_id", "file_no", "concept", "record"])


def unified(df: DataFrame, edits: DataFrame) -> DataFrame:
    """(raw_id, feed_id, file_no, concept, record): every record under the latest names of its feed and in one form for all, as canonical JSON."""
    kind = df.schema["raw_id"].dataType.simpleString()
    edits = edits.where("change_kind in ('renamed', 'moved')").groupBy(F.col("feed_id").alias("feed")).agg(F.sort_array(F.collect_list(F.array(F.col("file_no").cast("string"), "field_path", "change_kind", "new_path"))).alias("edits"))
    # One text a feed: the key under which its projections are compiled once in each task.
    edits = edits.select("feed", F.to_json(F.transform("edits", lambda e: e)).alias("edits"))
    rows = spread(df.select("raw_id", F.col("feed_id").cast("string").alias("feed"), F.col("file_no").cast("int").alias("file"), F.col("raw_json").cast("string").alias("line")))
    # Written once, as the forms and the result both read it.
    lines = cut(rows.join(edits, "feed", "left").select("raw_id", "feed", "file", "line", "edits").mapInArrow(projected, f"raw_id {kind}, feed string, file int, line string"))
    flat = cut(lines.select("feed", "line").mapInArrow(places_of, "feed string, concept string, top string, place string, above string, member string, types int, depth int, values array<string>"))
    seen = flat.groupBy("top", "place").agg(F.bit_or("types").alias("types"), F.max("depth").alias("depth"))
    # The member that plain values belong into where others are objects.
    mixed = seen.where(F.col("types").bitwiseAND(PLAIN) > 0).where(F.col("types").bitwiseAND(TYPE_BITS["object"]) > 0).select("place")
    named = flat.where(F.col("concept") != "null").select("feed", "concept", "place", "above", "member", F.explode("values").alias("value"))
    loose = named.join(mixed, "place", "left_semi").select("feed", "concept", "place", "value").distinct()
    held = named.select("feed", "concept", F.col("above").alias("place"), "member", "value").join(mixed, "place", "left_semi").distinct()
    votes = loose.join(held, ["feed", "concept", "place", "value"]).groupBy("place", "member").agg(F.count("*").alias("n"))
    member = votes.groupBy("place").agg(F.min_by("member", F.struct(-F.col("n"), "member")).alias("member"))
    form = seen.join(member, "place", "left").groupBy("top").agg(F.collect_list(F.struct("place", "types", "depth", "member")).alias("found"))
    form = form.select("top", "found").mapInArrow(forms, "top string, form string")
    # A feed gets the forms of the fields it has.
    given = flat.select("feed", "top").distinct().join(form, "top").groupBy("feed").agg(F.collect_list("form").alias("given"))
    joined = lines.join(given, lines["feed"].eqNullSafe(given["feed"]), "left").select("raw_id", lines["feed"], "file", "line", "given")
    return joined.mapInArrow(unify, f"raw_id {kind}, feed_id string, file_no int, concept string, record string")


def typed(table: DataFrame) -> DataFrame:
    """(raw_id, feed_id, file_no, record) of the unified table with the record as a struct of typed columns.

    Every place has one type in all records, so the types are those found in one pass over them; as many columns as
    there are places. Names that differ in case only need ``spark.sql.caseSensitive``.
    """
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/records-{uuid.uuid4().hex}"
    head = F.to_json(F.struct(F.col("raw_id").cast("string").alias("raw_id"), "feed_id", "file_no"))
    line = F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(',"record":'), "record", F.lit("}"))
    table.select(line.alias("value")).write.text(place)
    found = spark.read.json(place)
    if "record" not in found.columns:
        return spark.createDataFrame([], "raw_id string, feed_id string, file_no int, record struct<>").select(F.col("raw_id").cast(table.schema["raw_id"].dataType), "feed_id", "file_no", "record")
    given = [F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in ("feed_id", "file_no")]
    return found.select(F.col("raw_id").cast(table.schema["raw_id"].dataType), given[0], given[1].cast("int").alias("file_no"), "record")
