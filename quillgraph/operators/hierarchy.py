"""The hierarchy department > semester > subject > module > note, kept as five flat tables with foreign keys.

A collection is a table, a subcollection is equality of the foreign key, and a "collection group" is the whole table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names of the collections and of their parents' keys.
LEVELS = ("departments", "semesters", "subjects", "modules", "notes")
PARENT_KEY = {"semesters": "department_id", "subjects": "semester_id", "modules": "subject_id", "notes": "module_id"}
Tables = dict[str, DataFrame]


# --- listings -----------------------------------------------------------------------------------------------------


def label(kind: str) -> Column:
    if kind == "semesters":
        return F.concat_ws(" - ", F.col("semester_number").cast("string"), "name")
    if kind == "subjects":
        return F.concat_ws(" - ", "code", "name")
    if kind == "modules":
        return F.concat(F.lit("Module "), F.col("module_number").cast("string"), F.lit(" - "), F.col("name"))
    return F.col("title") if kind == "notes" else F.col("name")


_ORDER = {"departments": ["name"], "semesters": ["semester_number"], "subjects": ["name"], "modules": ["module_number"]}


def children(tables: Tables, kind: str, parent_id: str | None = None) -> DataFrame:
    """``id, label, type`` of the children of one node in display order; notes come newest first."""
    rows = tables[kind] if parent_id is None else tables[kind].where(F.col(PARENT_KEY[kind]) == parent_id)
    order = [F.desc("created_at"), F.asc("id")] if kind == "notes" else [F.asc(_ORDER[kind][0]), F.asc("id")]
    return rows.orderBy(*order).select("id", label(kind).alias("label"), F.lit(kind[:-1]).alias("type"))


def note_counts(tables: Tables) -> DataFrame:
    """``id, note_count, has_children`` of every module; the notes are counted before the join."""
    n = tables["notes"].groupBy(F.col("module_id").alias("id")).agg(F.count(F.lit(1)).alias("note_count"))
    return tables["modules"].select("id").join(n, "id", "left").select("id", F.coalesce("note_count", F.lit(0)).alias("note_count"), F.col("note_count").isNotNull().alias("has_children"))


def tree(tables: Tables, depth: int = 5) -> DataFrame:
    """One row a department with nested children, bottom up: four joins, each on an aggregate of the level below.

    Depth 1 gives departments only, 2 their semesters, and 3 or more everything. A row holds all that lies below a department, so this is for
    trees that one display can hold; ``tree_rows`` gives the same nodes at any size.
    """
    departments = tables["departments"].select("id", label("departments").alias("label"))
    if depth <= 1:
        return departments.select("id", "label", F.lit(None).cast("array<struct<id:string,label:string>>").alias("children"))

    def nested(level: DataFrame, key: str, order: list[Column], fields: list[str]) -> DataFrame:
        packed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("node")))), lambda x: x["node"])
        return level.groupBy(F.col(key).alias("id")).agg(packed.alias("children"))

    below = None
    if depth >= 3:
        notes = tables["notes"].select("id", "module_id", F.col("title").alias("label"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("_t"))
        below = nested(notes, "module_id", [-F.col("_t"), F.col("id")], ["id", "label"])
        counted = tables["modules"].select("id", "subject_id", label("modules").alias("label"), "module_number").join(below, "id", "left")
        counted = counted.withColumns({"note_count": F.coalesce(F.size("children"), F.lit(0)), "has_children": F.col("children").isNotNull()})
        below = nested(counted, "subject_id", [F.col("module_number"), F.col("id")], ["id", "label", "note_count", "has_children", "children"])
        subjects = tables["subjects"].select("id", "semester_id", label("subjects").alias("label"), "name").join(below, "id", "left")
        below = nested(subjects.withColumn("has_children", F.col("children").isNotNull()), "semester_id", [F.col("name"), F.col("id")], ["id", "label", "has_children", "children"])
    semesters = tables["semesters"].select("id", "department_id", label("semesters").alias("label"), "semester_number")
    fields = ["id", "label"]
    if below is not None:
        semesters = semesters.join(below, "id", "left").withColumn("has_children", F.col("children").isNotNull())
        fields += ["has_children", "children"]
    top = nested(semesters, "department_id", [F.col("semester_number"), F.col("id")], fields)
    return departments.join(top, "id", "left").select("id", "label", "children")


def tree_rows(tables: Tables) -> DataFrame:
    """``level, id, label, path, place``: one row for each node of the tree; nodes with a broken chain are left out.

    ``path`` lists the ids from the department to the node. Siblings stand in order of ``place`` (numbers; notes newest first), subjects of their name, and then of id.
    """
    places = {"semesters": F.col("semester_number").cast("long"), "modules": F.col("module_number").cast("long"), "notes": -F.unix_micros(F.col("created_at").cast("timestamp"))}
    out, above = [], None
    for number, name in enumerate(LEVELS):
        parent, place = PARENT_KEY.get(name), places.get(name, F.lit(None).cast("long"))
        rows = tables[name].select("id", label(name).alias("label"), place.alias("place"), *([F.col(parent).alias("_up")] if parent else []))
        if above is None:
            rows = rows.withColumn("path", F.array("id"))
        else:
            up = above.select(F.col("id").alias("_up"), F.col("path").alias("_path"))
            rows = rows.join(up, "_up").withColumn("path", F.concat("_path", F.array("id")))
        above = rows
        out.append(rows.select(F.lit(number).alias("level"), "id", "label", "path", "place"))
    return reduce(DataFrame.unionByName, out)


def semester_shapes(tables: Tables) -> DataFrame:
    """``id, subjects, shape``: for each semester that has subjects how many, and the MD5 of all that lies below, ``subject(module[note;note],module[])``, joined by commas in display order.

    Spark sorts the rows of the tree by subject; what a subject holds is one text, and a semester's texts pass one after the other through its digest: no row and no task holds a semester.
    """
    notes = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "id")))
    below = tables["notes"].groupBy(F.col("module_id").alias("id")).agg(F.array_join(F.transform(notes, lambda x: x["id"]), ";").alias("below"))
    told = tables["modules"].select("id", "subject_id", "module_number").join(below, "id", "left").withColumn("told", F.concat("id", F.lit("["), F.coalesce("below", F.lit("")), F.lit("]")))
    modules = F.array_sort(F.collect_list(F.struct("module_number", "id", "told")))
    below = told.groupBy(F.col("subject_id").alias("id")).agg(F.array_join(F.transform(modules, lambda x: x["told"]), ",").alias("below"))
    rows = tables["subjects"].where(F.col("semester_id").isNotNull()).select("id", "semester_id", "name").join(below, "id", "left")
    rows = rows.select("semester_id", "name", "id", F.concat("id", F.lit("("), F.coalesce("below", F.lit("")), F.lit(")")).alias("told"))
    rows = rows.repartition("semester_id").sortWithinPartitions("semester_id", F.col("name").asc_nulls_last(), F.col("id").asc_nulls_last())
    return rows.select("semester_id", "told").mapInArrow(_digests, "id string, subjects long, shape string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``id, text`` that come sorted by id the number of rows and the digest of the texts (null ones are left out) for each id."""

    def done(ident: str, n: int, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ident]), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["id", "subjects", "shape"])

    last, n, digest, begun = None, 0, hashlib.md5(), False
    for batch in batches:
        for ident, text in zip(batch.column(0), batch.column(1), strict=True):
            ident = ident.as_py()
            if n and ident != last:
                yield done(last, n, digest)
                n, digest, begun = 0, hashlib.md5(), False
            last, n = ident, n + 1
            if text.is_valid:
                digest.update((b"," if begun else b"") + text.as_buffer().to_pybytes())
                begun = True
    if n:
        yield done(last, n, digest)


def tree_shapes(tables: Tables) -> DataFrame:
    """``id, label, shape``: for each department its semesters in display order, each with the digest of what lies below (``semester_shapes``); null without semesters."""
    below = semester_shapes(tables)
    semesters = tables["semesters"].select("id", "department_id", "semester_number").join(below, "id", "left")
    told = semesters.select(F.col("department_id").alias("_up"), "semester_number", "id", F.concat("id", F.lit(":"), F.coalesce("shape", F.md5(F.lit("")))).alias("told"))
    listed = F.array_sort(F.collect_list(F.struct("semester_number", "id", "told")))
    top = told.groupBy(F.col("_up").alias("id")).agg(F.array_join(F.transform(listed, lambda x: x["told"]), ",").alias("shape"))
    return tables["departments"].select("id", label("departments").alias("label")).join(top, "id", "left").select("id", "label", "shape")


def keep_subjects(tables: Tables, subject_ids: DataFrame) -> Tables:
    """The tree without subjects outside the set (column ``id``) and without ancestors that then have none."""
    kept = dict(tables)
    kept["subjects"] = tables["subjects"].join(subject_ids.select("id").distinct(), "id", "left_semi")
    kept["semesters"] = tables["semesters"].join(kept["subjects"].select(F.col("semester_id").alias("id")), "id", "left_semi")
    kept["departments"] = tables["departments"].join(kept["semesters"].select(F.col("department_id").alias("id")), "id", "left_semi")
    kept["modules"] = tables["modules"].join(kept["subjects"].select(F.col("id").alias("subject_id")), "subject_id", "left_semi")
    kept["notes"] = tables["notes"].join(kept["modules"].select(F.col("id").alias("module_id")), "module_id", "left_semi")
    return kept


def with_ancestors(tables: Tables) -> DataFrame:
    """Every module with the ids of its subject, semester and department; those with a broken chain are left out."""
    m = tables["modules"].select(F.col("id").alias("module_id"), "subject_id")
    s = tables["subjects"].select(F.col("id").alias("subject_id"), "semester_id")
    t = tables["semesters"].select(F.col("id").alias("semester_id"), "department_id")
    d = tables["departments"].select(F.col("id").alias("department_id"))
    return m.join(s, "subject_id").join(t, "semester_id").join(d, "department_id").select("module_id", "subject_id", "semester_id", "department_id")


def path_exists(tables: Tables, department: str, semester: str, subject: str, module: str) -> DataFrame:
    """One row: whether the module lies in the subject, that in the semester, and that in the department."""
    chain = with_ancestors({**tables, "modules": tables["modules"].where(F.col("id") == module)})
    ok = (F.col("subject_id") == subject) & (F.col("semester_id") == semester) & (F.col("department_id") == department)
    return chain.agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("exists"))


def ancestors_of_path(path: Column) -> dict[str, Column]:
    """``department_id`` to ``module_id`` from a path ``/departments/../semesters/../subjects/../modules/..``; null where missing."""
    found = {}
    for level in LEVELS[:-1]:
        x = F.regexp_extract(path, rf"(?:^|/){level}/([^/]+)", 1)
        found[f"{level[:-1]}_id"] = F.when(x != "", x)
    return found


def semester_subjects(tables: Tables, department: str) -> DataFrame:
    """All subjects of all semesters of a department."""
    s = tables["semesters"].where(F.col("department_id") == department).select(F.col("id").alias("semester_id"), "semester_number")
    return tables["subjects"].join(s, "semester_id").select("id", "name", "code", "semester_id", "semester_number")


# --- changes ------------------------------------------------------------------------------------------------------


def move(tables: Tables, kind: str, ident: str, new_parent: str) -> DataFrame:
    """The table ``kind`` with one row under another parent; what lies below follows by its foreign keys.

    A parent that does not exist moves nothing.
    """
    parents = tables[LEVELS[LEVELS.index(kind) - 1]].where(F.col("id") == new_parent).select(F.lit(ident).alias("id"), F.col("id").alias("_parent"))
    key = PARENT_KEY[kind]
    moved = tables[kind].join(F.broadcast(parents.limit(1)), "id", "left")
    return moved.withColumn(key, F.coalesce("_parent", key)).select(*tables[kind].columns)


def delete(tables: Tables, kind: str, ids: DataFrame) -> Tables:
    """The tables without rows of ``kind`` whose id is in ``ids``, and without all that lies below."""
    out, gone = dict(tables), ids.select("id").distinct()
    for level in LEVELS[LEVELS.index(kind) :]:
        key = "id" if level == kind else PARENT_KEY[level]
        doomed = tables[level].join(gone.withColumnRenamed("id", key), key, "left_semi").select("id")
        out[level] = tables[level].join(gone.withColumnRenamed("id", key), key, "left_anti").select(*tables[level].columns)
        gone = doomed
    return out


def find(tables: Tables, ident: str) -> DataFrame:
    """``kind, id`` wherever the id occurs."""
    hits = [tables[x].where(F.col("id") == ident).select(F.lit(x).alias("kind"), "id") for x in LEVELS if x in tables]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out


def split_by_parent(rows: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent exists, and those to reject."""
    ids = parents.select(F.col("id").alias(key)).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def next_number(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One more than the largest number (1 where there is none above 0)."""
    return rows.groupBy(*keys).agg((F.greatest(F.lit(0), F.coalesce(F.max(column), F.lit(0))) + 1).alias("next"))


def next_code(rows: DataFrame, column: str, prefix: str, keys: list[str]) -> DataFrame:
    """The code after the largest of the form prefix and digits."""
    number = F.max(F.regexp_extract(column, rf"^{prefix}(\d+)$", 1).try_cast("int"))
    return rows.groupBy(*keys).agg(F.format_string(f"{prefix}%03d", F.coalesce(number, F.lit(0)) + 1).alias("next"))


def unique_name(base: str, siblings: DataFrame, column: str) -> DataFrame:
    """One row: the base name, with a number in brackets (one more than the largest, from 2) if it is taken."""
    quoted = r"^\Q" + base.replace(r"\E", r"\E\\E\Q") + r"\E"
    numbers = F.max(F.when(F.col(column) == base, 1).otherwise(F.regexp_extract(column, rf"{quoted} \((\d+)\)$", 1).try_cast("int")))
    taken = F.coalesce(F.bool_or(F.col(column) == base), F.lit(False))
    return siblings.agg(F.when(taken, F.concat(F.lit(f"{base} ("), (numbers + 1).cast("string"), F.lit(")"))).otherwise(base).alias("name"))


def rename_duplicates(rows: DataFrame, keys: list[str], column: str, order: list[str]) -> DataFrame:
    """Siblings with one name get numbers from the second on."""
    n = F.row_number().over(Window.partitionBy(*keys, column).orderBy(*order))
    return rows.withColumn(column, F.when(n > 1, F.concat(F.col(column), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(column)))


def accepted_departments(new: DataFrame, old: DataFrame) -> DataFrame:
    """New departments whose name is not taken (taken names are refused, not numbered)."""
    return new.join(old.select("name"), "name", "left_anti").select(*new.columns)


def insert_note(notes: DataFrame, title: str, path: str, **given: str | None) -> DataFrame:
    """One row to append: title unique among its siblings; ancestors named by the path win over those given."""
    spark = notes.sparkSession
    base = spark.range(1).select(F.lit(path).alias("path"))
    from_path = ancestors_of_path(F.col("path"))
    row = base.select(*[F.coalesce(c, F.lit(given.get(k)).cast("string")).alias(k) for k, c in from_path.items()])
    siblings = notes.join(F.broadcast(row.select("module_id")), "module_id", "left_semi")
    return row.join(F.broadcast(unique_name(title, siblings, "title").withColumnRenamed("name", "title")))


def bump(rows: DataFrame, column: str, ids: list[str], delta: int) -> DataFrame:
    """Adds to a counter, which never falls under zero."""
    changed = F.greatest(F.lit(0), F.coalesce(column, F.lit(0)) + delta)
    return rows.withColumn(column, F.when(F.col("id").isin(*ids), changed).otherwise(F.col(column)))


def archive(rows: DataFrame, ids: list[str]) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("id").isin(*ids), "archived").otherwise(F.col("status")))


def publish(modules: DataFrame, audit: DataFrame, ids: DataFrame, action: str, by: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Publishes or unpublishes: a module changes only from the other state, and each change leaves an audit row."""
    old, new = ("draft", "published") if action == "publish" else ("published", "draft")
    marked = modules.join(ids.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
    changes = F.coalesce(F.col("_asked"), F.lit(False)) & (F.coalesce("status", F.lit("draft")) == old)
    marked = marked.withColumn("_change", changes)
    log = marked.where("_change").select(F.col("id").alias("module_id"), F.lit(action).alias("action"), F.lit(by).alias("by"), at.alias("at"))
    after = marked.withColumn("status", F.when(F.col("_change"), new).otherwise(F.col("status"))).select(*modules.columns)
    return after, audit.unionByName(log)


def audit_log(audit: DataFrame, module_id: str | None = None, limit: int = 50) -> DataFrame:
    rows = audit if module_id is None else audit.where(F.col("module_id") == module_id)
    return rows.orderBy(F.desc("at"), "module_id", "action").limit(limit)


def page(rows: DataFrame, number: int, size: int, status: str | None = None, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of rows, newest first, and the total of all pages as one row."""
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if year is not None:
        rows = rows.where(F.col("year") == year)
    return rows.orderBy(F.desc("created_at"), "id").offset((number - 1) * size).limit(size), rows.agg(F.count(F.lit(1)).alias("total"))


# --- users --------------------------------------------------------------------------------------------------------


def users_with_names(users: DataFrame, departments: DataFrame, subjects: DataFrame, role: str | None = None, department: str | None = None) -> DataFrame:
    """Users with the names of their department and subjects (order kept, unknown ones ``Unknown``)."""
    if role is not None:
        users = users.where(F.col("role") == role)
    if department is not None:
        users = users.where(F.col("department_id") == department)
    named = users.join(departments.select(F.col("id").alias("department_id"), F.col("name").alias("department_name")), "department_id", "left")
    listed = users.select("uid", F.posexplode("subject_ids").alias("_i", "_s")).join(subjects.select(F.col("id").alias("_s"), "name"), "_s", "left")
    listed = listed.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("name", F.lit("Unknown")).alias("n")))), lambda x: x["n"]).alias("subject_names"))
    out = named.join(listed, "uid", "left")
    return out.withColumns({"department_name": F.coalesce("department_name", F.lit("Unknown")), "subject_names": F.coalesce("subject_names", F.array().cast("array<string>"))})


def role_counts(users: DataFrame) -> DataFrame:
    return users.agg(*[F.count_if(F.col("role") == r).alias(r) for r in ("admin", "staff", "student")], F.count(F.lit(1)).alias("total"))


def with_defaults(users: DataFrame) -> DataFrame:
    return users.withColumns({
        "status": F.coalesce("status", F.lit("active")), "subject_ids": F.coalesce("subject_ids", F.array().cast("array<string>")), "v": F.lit(1),
    })


def backfill_status(users: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows to write: users without a status, now active."""
    missing = users.where(F.col("status").isNull())
    return (missing if limit is None else missing.orderBy("uid").limit(limit)).withColumn("status", F.lit("active"))


def may_read(role: str, subject_ids: list[str] | None = None, department: str | None = None) -> Column:
    """Whether someone may read rows with ``subject_id`` and ``department_id``: admins all, staff their subjects or department, students none."""
    if role == "admin":
        return F.lit(True)
    if role == "staff":
        return F.coalesce(F.col("subject_id").isin(*(subject_ids or [""])) | (F.col("department_id") == (department or "")), F.lit(False))
    return F.lit(False)


def visible(users: DataFrame, rows: DataFrame) -> DataFrame:
    """``uid, id`` of the rows (``id, subject_id, department_id``) each user may read, for all users at once, by equi-joins.

    Admins see all, so they are answered with one row (id null) instead of a copy of the table.
    """
    staff = users.where("role = 'staff'")
    by_subject = staff.select("uid", F.explode("subject_ids").alias("subject_id")).join(rows.select("id", "subject_id"), "subject_id").select("uid", "id")
    by_department = staff.select("uid", "department_id").join(rows.select("id", "department_id"), "department_id").select("uid", "id")
    everything = users.where("role = 'admin'").select("uid", F.lit(None).cast(rows.schema["id"].dataType).alias("id"))
    return by_subject.unionByName(by_department).distinct().unionByName(everything)


def visible_counts(users: DataFrame, rows: DataFrame) -> DataFrame:
    """``uid, n``: how many ids ``visible`` gives each user, without its rows: these are as many as staff times the rows of their departments.

    Ids are counted once for each set of departments that have them; subjects add those ids of theirs that no department of the user has.
    """
    staff, none = users.where("role = 'staff'"), F.lit(0).cast("long")
    grants = staff.where(F.col("department_id").isNotNull()).select("uid", "department_id").distinct()
    placed = rows.where(F.col("department_id").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_set("department_id")).alias("departments"))
    sets = placed.groupBy("departments").agg(F.count("id").alias("n"))
    by_department = grants.join(sets.withColumn("department_id", F.explode("departments")), "department_id").select("uid", "departments", "n").distinct().select("uid", "n")
    listed = staff.select("uid", F.explode("subject_ids").alias("subject_id")).join(rows.select("id", "subject_id"), "subject_id").select("uid", "id").distinct()
    known = listed.join(rows.select("id", "department_id"), listed["id"].eqNullSafe(rows["id"])).select("uid", listed["id"], "department_id").distinct()
    reached = known.alias("k").join(grants.alias("g"), F.col("k.uid").eqNullSafe(F.col("g.uid")) & (F.col("k.department_id") == F.col("g.department_id")), "left")
    extra = reached.groupBy("k.uid", "k.id").agg(F.count("g.department_id").alias("_d")).where("_d = 0").groupBy("uid").agg(F.count("id").alias("n"))
    everything = users.where("role = 'admin'").select("uid", none.alias("n"))
    return by_department.unionByName(extra).unionByName(everything).groupBy("uid").agg(F.sum("n").alias("n"))


def user_problems() -> Column:
    """What is wrong with a user row, as an array of texts; empty for a valid one."""
    checks = [
        (~F.coalesce(F.length("display_name").between(1, 199), F.lit(False)), "name"),
        (~F.coalesce(F.col("role").isin("admin", "staff", "student"), F.lit(False)), "role"),
        (F.coalesce(F.col("role").isin("staff", "student"), F.lit(False)) & F.col("department_id").isNull(), "department"),
        (F.coalesce(F.col("role") == "staff", F.lit(False)) & (F.coalesce(F.size("subject_ids"), F.lit(0)) <= 0), "subjects"),
        (F.col("status").isNotNull() & ~F.col("status").isin("active", "disabled"), "status"),
    ]
    return F.filter(F.array(*[F.when(bad, text) for bad, text in checks]), lambda x: x.isNotNull())


# --- batches of notes ---------------------------------------------------------------------------------------------


def processing_queue(notes: DataFrame, path: str, now: Column) -> DataFrame:
    """Notes that are being processed, with the module from their path; a missing start counts as now."""
    rows = notes.where(F.col("kg_status") == "processing")
    return rows.select("id", F.regexp_extract(path, "/modules/([^/]+)", 1).alias("module_id"), F.coalesce("started_at", now).alias("started_at"))


def batch_intake(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """``id, decision`` for each asked ``id, module_id``: missing or elsewhere: dropped; ready: skipped; else queued."""
    known = notes.select("id", F.col("module_id").alias("_m"), "kg_status")
    decision = F.when(F.col("_m").isNull() | (F.col("_m") != F.col("module_id")), "dropped").when(F.col("kg_status") == "ready", "skipped").otherwise("queued")
    return asked.join(known, "id", "left").select("id", decision.alias("decision"))


def batch_delete(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """``id, ok, reason`` for each asked ``id, module_id``: only notes that are ready, and in the module, can go."""
    known = notes.select("id", F.col("module_id").alias("_m"), "kg_status")
    reason = F.when(F.col("_m").isNull(), "not found").when(F.col("_m") != F.col("module_id"), "other module").when(~F.coalesce(F.col("kg_status") == "ready", F.lit(False)), "not ready")
    return asked.join(known, "id", "left").select("id", reason.isNull().alias("ok"), reason.alias("reason"))


def eligible(notes: DataFrame) -> DataFrame:
    """How many of the selected notes would be processed and how many skipped."""
    go = F.col("kg_status").isNull() | F.col("kg_status").isin("pending", "failed")
    return notes.agg(F.count_if(go).alias("process"), F.count_if(~go).alias("skipped"))


def selected_range(rows: DataFrame, order: list[str], anchor: str, target: str) -> DataFrame:
    """The rows between two of them in display order, both included. Order and limits are those of one folder's listing."""
    place = F.struct(*order, "id")  # a range of sort keys: nothing is ranked
    ends = rows.where(F.col("id").isin(anchor, target)).agg(F.min(place).alias("_a"), F.max(place).alias("_b"))
    return rows.join(F.broadcast(ends), place.between(F.col("_a"), F.col("_b"))).select(*rows.columns)


def cascade_status(graph_state: Column, deleted: Column) -> Column:
    """What deleting a note did: graph first where there is one; if that fails the note stays."""
    return F.when((graph_state == "ready") & ~deleted, "kg_failed").when(graph_state == "ready", "complete").otherwise("document_only")
