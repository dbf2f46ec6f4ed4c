"""Library tables: listing, upserts, deletes, jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.text import lit
from docframe.operators.ordered import first_per_key, in_order, sql, top_per_key

# Job states that count as open.
OPEN_JOBS = "('queued', 'running')"


def replace_documents(
    target: DataFrame, batch: DataFrame, keys: Sequence[str] = ("paper_id",), renewed: DataFrame | None = None
) -> DataFrame:
    """Target with all rows of the batch's documents replaced (S11). Repeating it changes nothing.

    ``renewed`` names the documents to replace where some of them have no row in the batch."""
    renewed = (batch if renewed is None else renewed).select(*keys).distinct()
    return target.join(renewed, list(keys), "left_anti").unionByName(batch)


def upsert(
    target: DataFrame, batch: DataFrame, key: str, owner: str = "user_id", fill_only: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Insert unknown keys and update the owner's rows; rows of another owner come back as
    conflicts (S12). Columns in ``fill_only`` change only where they are empty."""
    new = [c for c in batch.columns if c not in (key, owner)]
    # Rows of another owner stay as they are; never null.
    other = f"(t.`{key}` IS NOT NULL AND n.`{key}` IS NOT NULL AND NOT (t.`{owner}` <=> n.`{owner}`))"
    value = {
        c: f"IF({other}, t.`{c}`, coalesce(nullif(t.`{c}`, ''), n.`{c}`))" if c in fill_only
        else f"IF(n.`{key}` IS NULL OR {other}, t.`{c}`, n.`{c}`)"
        for c in new
    }
    cols = ", ".join(
        f"{value[c]} AS `{c}`" if c in value else f"t.`{c}`"
        for c in target.columns if c not in (key, owner)
    )
    joined = f"FROM {{t}} t FULL OUTER JOIN {{n}} n ON t.`{key}` = n.`{key}`"
    merged = sql(
        f"SELECT coalesce(t.`{key}`, n.`{key}`) AS `{key}`, IF(t.`{key}` IS NULL, n.`{owner}`, t.`{owner}`) AS `{owner}`, "
        f"{cols} {joined}",
        t=target,
        n=batch,
    )
    conflicts = sql(
        f"SELECT n.* FROM {{n}} n JOIN {{t}} t ON t.`{key}` = n.`{key}` WHERE NOT (t.`{owner}` <=> n.`{owner}`)",
        t=target,
        n=batch,
    )
    return merged.select(*target.columns), conflicts


def delete_owned(
    parents: DataFrame, children: dict[str, DataFrame], wanted: DataFrame, key: str, owner: str = "user_id"
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Owner-scoped delete with its cascade (S13). ``wanted`` holds (key, owner)."""
    gone = parents.join(wanted.select(key, owner).distinct(), [key, owner], "left_semi").select(key)
    rest = {name: df.join(gone, key, "left_anti") for name, df in children.items()}
    return parents.join(gone, key, "left_anti"), rest


def latest_open_job(jobs: DataFrame, papers: DataFrame) -> DataFrame:
    """Newest queued or running job per paper, visible through the paper only."""
    seen = jobs.filter(f"status IN {OPEN_JOBS}").join(papers.select("paper_id"), "paper_id", "left_semi")
    return first_per_key(seen, ["paper_id"], "created_at DESC, job_id DESC")


def failure_conflicts(papers: DataFrame, failures: DataFrame) -> DataFrame:
    """Failures that name another owner than the paper's; ``record_failures`` leaves them out."""
    if "user_id" not in failures.columns:
        return failures.limit(0)
    owners = papers.selectExpr("paper_id", "user_id AS __owner")
    return failures.join(owners, "paper_id").filter("NOT (__owner <=> user_id)").drop("__owner")


def record_failures(papers: DataFrame, jobs: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failure state on papers, and their job closed as failed (S15). Unknown papers are added.

    Failures: ``paper_id, status, parse_status, error, warnings, page_count, job_id`` and, if
    known, ``user_id, filename, storage_uri, artifacts``, which are noted too; a null job id
    means the paper's newest open job.
    """
    failures = failures.join(failure_conflicts(papers, failures).select("paper_id").distinct(), "paper_id", "left_anti")
    fields = ("status", "parse_status", "error", "warnings", "page_count")
    known = [c for c in ("user_id", "filename", "storage_uri", "artifacts") if c in failures.columns and c in papers.columns]
    noted = failures.selectExpr("paper_id", "true AS __hit", *[f"`{c}` AS __{c}" for c in (*fields, *known)])
    out = papers.join(noted, "paper_id", "full").selectExpr(
        *[
            f"IF(__hit, __{c}, `{c}`) AS `{c}`" if c in fields else f"coalesce(__{c}, `{c}`) AS `{c}`" if c in known else f"`{c}`"
            for c in papers.columns
        ]
    )
    newest = latest_open_job(jobs, papers).selectExpr("paper_id", "job_id AS __newest")
    closing = failures.join(newest, "paper_id", "left").selectExpr(
        "coalesce(job_id, __newest) AS job_id", "error AS __error", "true AS __hit"
    ).filter("job_id IS NOT NULL")
    changes = {"status": "'failed'", "progress": "1D", "error": "__error"}
    shut = jobs.join(closing, "job_id", "left").selectExpr(
        *[f"IF(__hit, {changes[c]}, `{c}`) AS `{c}`" if c in changes else f"`{c}`" for c in jobs.columns]
    )
    return out, shut


def list_papers(
    papers: DataFrame,
    *,
    q: str | None = None,
    status: str | None = None,
    author: str | None = None,
    year: int | None = None,
    user_id: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Newest first, filters before the page is cut (D3, D4). ``%`` and ``_`` in ``q`` are wildcards."""
    if user_id is not None:
        papers = papers.filter(F.col("user_id") == user_id)
    if status:
        papers = papers.filter(F.col("status") == status)
    if year is not None:
        papers = papers.filter(F.col("publication_year") == year)
    if q:
        papers = papers.filter(F.col("title").ilike(f"%{q}%") | F.col("filename").ilike(f"%{q}%"))
    if author:
        papers = author_filter(papers, author)
    return papers.orderBy(F.col("created_at").desc(), "paper_id").offset(offset).limit(limit)


def author_filter(papers: DataFrame, author: str) -> DataFrame:
    """Any author or the title contains the text, ignoring case."""
    a = lit(author.lower())
    return papers.filter(
        f"coalesce(exists(authors, x -> contains(lower(x), {a})), false) OR coalesce(contains(lower(title), {a}), false)"
    )


def get_paper(papers: DataFrame, paper_id: str, user_id: str | None = None, **children: DataFrame) -> dict[str, DataFrame]:
    """One paper, if its owner asks, and its rows of the other tables (D5): ``paper`` and a
    table for each of ``children`` (sections, visuals, jobs, ...), empty for another's paper."""
    seen = papers.filter(F.col("paper_id") == paper_id)
    if user_id is not None:
        seen = seen.filter(F.col("user_id") == user_id)
    # The id is pushed into the scans; only whether the paper is visible is joined.
    rows = {name: df.filter(F.col("paper_id") == paper_id).join(seen.select("paper_id"), "paper_id", "left_semi") for name, df in children.items()}
    return {"paper": seen} | rows


def count_related(papers: DataFrame, **children: DataFrame) -> DataFrame:
    """Number of child rows per paper and table."""
    out = papers.select("paper_id")
    for name, child in children.items():
        counts = child.groupBy("paper_id").agg(F.expr(f"count(*) AS `{name}`"))
        out = out.join(counts, "paper_id", "left")
    return out.selectExpr("paper_id", *[f"coalesce(`{n}`, 0) AS `{n}`" for n in children])


def fold_job_updates(jobs: DataFrame, updates: DataFrame, fields: Sequence[str] = ("status", "progress", "error", "result")) -> DataFrame:
    """Apply partial updates in time order: null keeps the field (D7). Ties go to the higher
    update id, then to the higher value."""
    last = ", ".join(
        f"max(IF(`{f}` IS NULL, NULL, named_struct('t', ts, 'u', update_id, 'v', `{f}`))).v AS `__{f}`" for f in fields
    )
    folded = sql(f"SELECT job_id, {last}, max(ts) AS __ts FROM {{u}} GROUP BY job_id", u=updates)
    return jobs.join(folded, "job_id", "left").selectExpr(
        *[
            f"coalesce(`__{c}`, `{c}`) AS `{c}`" if c in fields
            else ("coalesce(__ts, updated_at) AS updated_at" if c == "updated_at" else f"`{c}`")
            for c in jobs.columns
        ]
    )


def document_overview(papers: DataFrame, sections: DataFrame, elements: DataFrame, visuals: DataFrame, n: int = 30) -> DataFrame:
    """Title or filename, pages, first sections, counts of text and visuals."""
    head = top_per_key(sections, ["paper_id"], n, "order_index")
    return sql(
        f"""
        SELECT p.paper_id, coalesce(nullif(p.title, ''), p.filename) AS title, p.page_count,
          coalesce(s.headings, CAST(array() AS array<string>)) AS headings, coalesce(e.n, 0) AS text,
          coalesce(v.tables, 0) AS tables, coalesce(v.figures, 0) AS figures, coalesce(v.formulas, 0) AS formulas
        FROM {{p}} p
        LEFT JOIN (SELECT paper_id, {in_order('order_index', 'heading')} AS headings FROM {{s}} GROUP BY paper_id) s USING (paper_id)
        LEFT JOIN (SELECT paper_id, count(*) AS n FROM {{e}} GROUP BY paper_id) e USING (paper_id)
        LEFT JOIN (SELECT paper_id, count_if(type = 'table') AS tables, count_if(type = 'figure') AS figures,
            count_if(type = 'formula') AS formulas FROM {{v}} GROUP BY paper_id) v USING (paper_id)
        """,
        p=papers,
        s=head,
        e=elements.select("paper_id"),
        v=visuals.select("paper_id", "type"),
    )
