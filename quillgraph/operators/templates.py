"""Document templates: which kind of document a text is, its sections, and how good an extraction from it was.

Templates are a small parameter; users may pass their own. They can also live in a table of patterns, to which templates are added without new code, and be applied by a table function in SQL.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Section(NamedTuple):
    name: str
    patterns: tuple[str, ...]
    focus: tuple[str, ...]
    required: bool = False


class Template(NamedTuple):
    name: str
    patterns: tuple[str, ...]
    sections: tuple[Section, ...]


def _headings(*words: str) -> tuple[str, ...]:
    """Line-anchored patterns for headings that begin with one of the words."""
    return tuple(rf"(?im)^[#\s\d.]*{w}\b" for w in words)


# The kinds of documents, the names of their sections, what these focus on and which are required. The patterns are our own.
TEMPLATES = (
    Template("lecture_notes", _headings("lecture", "course", "week", "chapter", "learning objectives", "professor", "lesson"), (
        Section("Introduction", _headings("introduction", "overview", "background", "motivation"), ("Topic",), True),
        Section("Main Topics", _headings("main topics?", "topics?", "content"), ("Topic", "Concept"), True),
        Section("Key Concepts", _headings("key concepts?", "concepts?", "terms"), ("Concept",)),
        Section("Examples", _headings("examples?", "exercises?", "problems?", "practice"), ("Methodology",)),
        Section("Summary", _headings("summary", "recap", "takeaways?", "review"), ("Finding",)),
    )),
    Template("research_paper", _headings("abstract", "keywords", "introduction", "related work", "method(?:s|ology)?", "results", "discussion", "conclusions?", "references", "acknowledge?ments?"), (
        Section("Abstract", _headings("abstract", "synopsis"), ("Topic", "Finding"), True),
        Section("Introduction", _headings("introduction", "background"), ("Topic", "Concept"), True),
        Section("Methodology", _headings("method(?:s|ology)?", "approach", "experimental setup"), ("Methodology",), True),
        Section("Results", _headings("results", "findings", "evaluation"), ("Finding",), True),
        Section("Discussion", _headings("discussion", "analysis"), ("Concept", "Finding")),
        Section("Conclusion", _headings("conclusions?", "future work"), ("Finding",)),
    )),
    Template("meeting_notes", _headings("meeting", "attendees", "agenda", "minutes", "action items?", "decisions?", "present", "date", "next meeting"), (
        Section("Attendees", _headings("attendees", "participants", "present"), ("Topic",)),
        Section("Agenda", _headings("agenda", "topics", "items"), ("Topic",)),
        Section("Discussion", _headings("discussion", "notes", "minutes"), ("Topic", "Concept"), True),
        Section("Action Items", _headings("action items?", "to-?dos?", "next steps"), ("Methodology",)),
        Section("Decisions", _headings("decisions?", "resolutions?", "agreed"), ("Finding",)),
    )),
    Template("lab_report", _headings("lab(?:oratory)?", "objective", "materials?", "procedure", "observations?", "hypothesis", "data", "apparatus"), (
        Section("Objective", _headings("objectives?", "aim", "purpose"), ("Topic",), True),
        Section("Materials", _headings("materials?", "apparatus", "equipment"), ("Concept",)),
        Section("Procedure", _headings("procedure", "method", "steps"), ("Methodology",), True),
        Section("Observations", _headings("observations?", "data", "measurements?"), ("Finding",)),
        Section("Analysis", _headings("analysis", "calculations?", "discussion"), ("Finding", "Concept")),
        Section("Conclusion", _headings("conclusions?", "summary"), ("Finding",)),
    )),
    Template("case_study", _headings("case study", "background", "problem", "challenge", "solution", "outcome", "lessons learned"), (
        Section("Background", _headings("background", "context", "overview", "company"), ("Topic", "Concept"), True),
        Section("Problem", _headings("problem", "challenge", "issue"), ("Concept",), True),
        Section("Analysis", _headings("analysis", "assessment", "evaluation"), ("Methodology",)),
        Section("Solution", _headings("solution", "approach", "implementation"), ("Methodology", "Concept"), True),
        Section("Outcome", _headings("outcome", "results?", "impact"), ("Finding",)),
        Section("Lessons Learned", _headings("lessons", "takeaways?", "recommendations?"), ("Finding",)),
    )),
)
GENERIC = Template("generic", (), (Section("Content", _headings(r"\S"), ("Topic", "Concept", "Methodology", "Finding"), True),))


def _share(flags: list[Column]) -> Column:
    return sum((f.cast("double") for f in flags), F.lit(0.0)) / max(1, len(flags)) if flags else F.lit(1.0)


def score(text: Column, template: Template) -> Column:
    """0.4 for the template's patterns (half of them suffice), 0.6 for its sections (0.7 required, 0.3 optional)."""
    hits = sum((text.rlike(p).cast("double") for p in template.patterns), F.lit(0.0))
    found = {s.name: F.greatest(*[text.rlike(p) for p in s.patterns], F.lit(False)) for s in template.sections}
    required = _share([found[s.name] for s in template.sections if s.required])
    optional = _share([found[s.name] for s in template.sections if not s.required])
    return 0.4 * F.least(2 * hits / max(1, len(template.patterns)), F.lit(1.0)) + 0.6 * (0.7 * required + 0.3 * optional)


def detect(df: DataFrame, key: str, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``key, template, score, alternatives`` (the next three): the best template above 0.3, else generic at 0.2; short texts are generic at 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    scored = F.array(*[F.struct((-F.round(score(t, x), 9)).alias("s"), F.lit(i).alias("i"), F.lit(x.name).alias("n")) for i, x in enumerate(templates)])
    ranked = F.array_sort(scored)
    rows = df.select(key, t.alias("_t"), ranked.alias("_r"))
    best = F.col("_r")[0]
    short = F.length("_t") < 50
    name = F.when(~short & (-best["s"] > 0.3), best["n"]).otherwise("generic")
    value = F.when(short, 0.0).when(-best["s"] > 0.3, -best["s"]).otherwise(0.2)
    others = F.transform(F.slice(F.filter("_r", lambda x: x["n"] != name), 1, 3), lambda x: x["n"])
    return rows.select(key, name.alias("template"), F.round(value, 4).alias("score"), others.alias("alternatives"))


def sections(df: DataFrame, key: str, template: Template, text: str = "text") -> DataFrame:
    """``key, section, start, end, confidence``: lines [start, end) of each section of a document.

    A section begins at its first matching line and ends where the next one begins. A document without any is one section,
    the template's first, at confidence 0.5.
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "content"))
    names = F.filter(
        F.array(*[F.when(F.greatest(*[F.col("content").rlike(p) for p in s.patterns], F.lit(False)), F.lit(s.name)) for s in template.sections]), lambda x: x.isNotNull()
    )
    first = lines.select(key, "line", F.explode(names).alias("section")).groupBy(key, "section").agg(F.min("line").alias("start"))
    total = df.select(key, F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_n"))
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(template.sections) for x in (s.name, i)])
    sure = F.create_map(*[F.lit(x) for s in template.sections for x in (s.name, 0.9 if s.required else 0.8)])
    w = Window.partitionBy(key).orderBy("start", "_o")
    found = first.withColumn("_o", rank[F.col("section")]).withColumn("_next", F.lead("start").over(w))
    joined = total.join(found, key, "left")
    return joined.select(
        key, F.coalesce("section", F.lit(template.sections[0].name)).alias("section"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("_next", "_n").alias("end"),
        F.when(F.col("section").isNull(), 0.5).otherwise(sure[F.col("section")]).alias("confidence"),
    )


def quality(found: Column, total: Column, missing_required: Column, entities: Column, confidence: Column) -> Column:
    """0.4 for sections (less 0.1 for each required one that is missing), 0.3 for entities (ten suffice), 0.3 for confidence; within [0, 1]."""
    part = F.greatest(F.lit(0.0), F.when(total > 0, found / total).otherwise(0.0) - 0.1 * missing_required)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * part + 0.3 * F.least(entities / 10.0, F.lit(1.0)) + 0.3 * confidence))


# --- templates as a table ------------------------------------------------------------------------------------------

#: A row for each pattern; ``section`` is null for the template's own ones. ``at`` orders templates, sections and patterns; a later ``version`` of a name replaces all before.
TABLE = "template string, version long, at long, section string, required boolean, focus array<string>, pattern string"
#: So many patterns at most are applied; each is one expression of the plan.
MAX_PATTERNS = 5000


def as_rows(templates: tuple[Template, ...], version: int = 0) -> list[tuple]:
    out = []
    for t in templates:
        out += [(t.name, version, None, None, None, p) for p in t.patterns]
        for s in t.sections:
            out += [(t.name, version, s.name, s.required, list(s.focus), p) for p in s.patterns]
    return [(name, v, at, section, required, focus, p) for at, (name, v, section, required, focus, p) in enumerate(out)]


def create_table(spark: SparkSession, path: str, templates: tuple[Template, ...] = TEMPLATES) -> None:
    """Writes the built-in templates as the first version of a table of templates."""
    spark.createDataFrame(as_rows(templates), TABLE).coalesce(1).write.parquet(path)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(path)


def add_template(spark: SparkSession, path: str, template: Template) -> None:
    """Adds a template, or replaces the one of its name. Names, sections and patterns must be there, and patterns must be valid."""
    if not template.name.strip() or template.name == GENERIC.name:
        raise ValueError(f"a template needs a name of its own, not {template.name!r}")
    if not template.patterns or not template.sections or any(not s.patterns for s in template.sections):
        raise ValueError("a template needs patterns and sections, and each section a pattern")
    for p in (*template.patterns, *(p for s in template.sections for p in s.patterns)):
        try:
            spark.range(1).select(F.lit("").rlike(p)).collect()
        except Exception as e:
            raise ValueError(f"the pattern {p!r} is not valid") from e
    version = 1 + (_table(spark, path).agg(F.max("version")).first()[0] or 0)
    spark.createDataFrame(as_rows((template,), version), TABLE).coalesce(1).write.mode("append").parquet(path)


def remove_template(spark: SparkSession, path: str, name: str) -> None:
    """From now on the name stands for nothing."""
    version = 1 + (_table(spark, path).agg(F.max("version")).first()[0] or 0)
    spark.createDataFrame([(name, version, 0, None, None, None, None)], TABLE).coalesce(1).write.mode("append").parquet(path)


def read_templates(spark: SparkSession, path: str) -> tuple[Template, ...]:
    """The last version of each template, in the order in which their names first came."""
    rows = _table(spark, path)
    names = rows.groupBy("template").agg(F.max("version").alias("version"), F.min(F.struct("version", "at")).alias("first"))
    last = rows.join(names, ["template", "version"]).where(F.col("pattern").isNotNull()).orderBy("first", "at").limit(MAX_PATTERNS + 1).collect()
    if len(last) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    by_name: dict[str, list] = {}
    for r in last:
        by_name.setdefault(r.template, []).append(r)
    out = []
    for name, own in by_name.items():
        by_section: dict[str, list] = {}
        for r in own:
            if r.section is not None:
                by_section.setdefault(r.section, []).append(r)
        found = tuple(Section(s, tuple(r.pattern for r in rs), tuple(rs[0].focus or ()), bool(rs[0].required)) for s, rs in by_section.items())
        out.append(Template(name, tuple(r.pattern for r in own if r.section is None), found))
    return tuple(out)


def plain_score(text: str, template: Template) -> float:
    """``score`` of one text."""

    def share(sections: list[Section]) -> float:
        return sum(any(re.search(p, text) for p in s.patterns) for s in sections) / len(sections) if sections else 1.0

    hits = sum(bool(re.search(p, text)) for p in template.patterns)
    required, optional = (share([s for s in template.sections if s.required == r]) for r in (True, False))
    return 0.4 * min(2 * hits / max(1, len(template.patterns)), 1.0) + 0.6 * (0.7 * required + 0.3 * optional)


def register_function(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES, name: str = "detect_templates") -> None:
    """A table function for SQL: ``SELECT … FROM docs, LATERAL detect_templates(text)`` gives ``rank, template, score`` of each template, best first."""
    known = templates

    @F.udtf(returnType="rank int, template string, score double")
    class Detect:
        def eval(self, text: str):
            scored = sorted((-plain_score(text or "", t), i, t.name) for i, t in enumerate(known))
            for rank, (s, _, found) in enumerate(scored, 1):
                yield rank, found, round(-s, 4)

    spark.udtf.register(name, Detect)
