"""Per-project recency top-N (O1-O3, S9, S10), relevance ranking (J8, O4),
context bundles (J7, A4) and status (A1, A3)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.functions import levels as L
from briefloom.functions.text import relevance_haystack, relevance_score, tokenize


_LOCATOR = ["_at_file", "_at_row"]


def _located(df: DataFrame) -> DataFrame | None:
    """``df`` with the file and place of each row, if it is a selection of one table's rows; else None."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        node = node.children().head()
    if not node.nodeName().startswith(("LogicalRelation", "Relation")):
        return None
    try:
        return df.select("*", F.col("_metadata.file_path").alias(_LOCATOR[0]), F.col("_metadata.row_index").alias(_LOCATOR[1]))
    except AnalysisException:  # a table of no files, or of files without places
        return None


def newest_per_project(df: DataFrame, n: int, time_col: str, id_col: str = "id",
                       rank_col: str = "recency_rank") -> DataFrame:
    """Rows ranked newest-first per project, keeping rank <= n.

    A partial ``WindowGroupLimit`` keeps n rows of a project in each input
    partition.  Of a table's rows only (project, time, id) and the row's place
    in its file are sorted, and texts and lists are fetched for the winners by
    a join on the place, which no two rows share and none lacks; other frames
    are ranked whole.  Ties on time go to the larger id.  A null project is one
    of its own, null times and ids come last, repeated rows rank one by one.
    """
    w = Window.partitionBy("project_id").orderBy(F.col(time_col).desc(), F.col(id_col).desc())
    located = _located(df)
    if located is None:
        return (df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
                .withColumn(rank_col, F.col(rank_col).cast("bigint")))
    best = (located.select("project_id", id_col, time_col, *_LOCATOR).withColumn(rank_col, F.row_number().over(w))
            .where(F.col(rank_col) <= n).select(*_LOCATOR, F.col(rank_col).cast("bigint").alias(rank_col)))
    return located.join(best, _LOCATOR).select(*df.columns, rank_col)


def recent_outputs(outputs: DataFrame, n: int) -> DataFrame:
    """O1 (and S10 with n=100). ``raw_text`` is left out unless the caller asks."""
    cols = [c for c in outputs.columns if c != "raw_text"]
    return newest_per_project(outputs.select(*cols), n, "created_at")


def recent_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """O2."""
    return newest_per_project(sessions, n, "created_at")


def recent_doc_summaries(documents: DataFrame, n: int) -> DataFrame:
    """O3 (+F10): newest documents with a non-empty summary."""
    d = documents.where(F.col("summary") != "").select(
        "id", "project_id", "relative_path", "summary", "kind", "modified_at")
    return newest_per_project(d, n, "modified_at")


def documents_by_project(documents: DataFrame) -> DataFrame:
    """A project's documents by relative path (range-partitioned sort)."""
    return documents.orderBy("project_id", "relative_path")


def rank_documents(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """J8 + O4: score each request's context documents against its goal.

    ``requests``: (request_id, project_id, goal, doc_limit).  The recency cut
    happens first, as in the reference (O3 with the largest level limit, then
    each request's own limit), so each request meets at most 15 documents of
    its project and the join output is bounded by 15 x requests whatever the
    project skew.  Within a request, a stable sort by score descending keeps
    recency order for ties (a goal without tokens keeps the recency order).
    Returns (request_id, project_id, doc_id, relative_path, summary, score,
    recency_rank, relevance_rank).
    """
    # the haystack is lower-cased once per document, before the join
    docs = recent_doc_summaries(documents, L.MAX_CONTEXT_DOCS).select(
        F.col("id").alias("doc_id"), "project_id", "relative_path", "summary", "recency_rank",
        relevance_haystack("relative_path", "summary").alias("_hay"))
    req = requests.select("request_id", "project_id", tokenize("goal").alias("tokens"), "doc_limit")
    j = req.join(docs, "project_id").where(F.col("recency_rank") <= F.col("doc_limit"))
    scored = j.withColumn("score", relevance_score("tokens", "_hay"))
    w = Window.partitionBy("request_id").orderBy(F.col("score").desc(), F.col("recency_rank").asc())
    # the texts stay behind while requests are sorted
    ranked = (scored.select("request_id", "project_id", "doc_id", "score", "recency_rank")
              .withColumn("relevance_rank", F.row_number().over(w).cast("bigint"))
              .join(docs.select("project_id", "doc_id", "relative_path", "summary"), ["project_id", "doc_id"]))
    return ranked.select("request_id", "project_id", "doc_id", "relative_path", "summary",
                         "score", "recency_rank", "relevance_rank")


def rank_documents_by_token(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """``rank_documents`` for many requests: each token is looked for once per project.

    A project's documents are searched for every *distinct* token that its
    requests have, at most 15 texts a token; a request's score of a document is
    then the sum over its tokens that were found; without a token (or with a
    null goal) it is 0.  Texts meet tokens in one join; the winners' come last.
    """
    docs = recent_doc_summaries(documents, L.MAX_CONTEXT_DOCS).select(
        F.col("id").alias("doc_id"), "project_id", "relative_path", "summary", "recency_rank",
        relevance_haystack("relative_path", "summary").alias("_hay"))
    req = requests.select("request_id", "project_id", tokenize("goal").alias("tokens"), "doc_limit")
    asked = (req.select("request_id", "project_id", F.explode("tokens").alias("token"))
             .groupBy("request_id", "project_id", "token").agg(F.count("*").alias("times")))
    found = (asked.select("project_id", "token").distinct()
             .join(docs.select("project_id", "doc_id", "_hay"), "project_id").where(F.contains("_hay", "token"))
             .select("project_id", "token", "doc_id"))
    scores = asked.join(found, ["project_id", "token"]).groupBy("request_id", "doc_id").agg(F.sum("times").alias("score"))
    pairs = (req.select("request_id", "project_id", "doc_limit").join(docs.select("project_id", "doc_id", "recency_rank"), "project_id")
             .where(F.col("recency_rank") <= F.col("doc_limit")).select("request_id", "project_id", "doc_id", "recency_rank"))
    w = Window.partitionBy("request_id").orderBy(F.col("score").desc(), F.col("recency_rank").asc())
    ranked = (pairs.join(scores, ["request_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("bigint"))
              .withColumn("relevance_rank", F.row_number().over(w).cast("bigint")))
    return (ranked.join(docs.select("project_id", "doc_id", "relative_path", "summary"), ["project_id", "doc_id"])
            .select("request_id", "project_id", "doc_id", "relative_path", "summary", "score", "recency_rank", "relevance_rank"))


def _ordered(fields: list[str], name: str) -> Column:
    """A4: rows of one project gathered into a list in recency order.  The
    list is sorted on an explicit rank, never on collection order."""
    return F.transform(
        F.sort_array(F.collect_list(F.struct(F.col("recency_rank").alias("_r"), *fields))),
        lambda s: s.dropFields("_r"),
    ).alias(name)


def context_bundles(projects: DataFrame, outputs: DataFrame, sessions: DataFrame, documents: DataFrame,
                    max_outputs: int, max_sessions: int, max_docs: int) -> DataFrame:
    """One row per project with its newest outputs, sessions and doc
    summaries as ordered arrays of structs.

    Each side is cut to n rows per project and folded to one row per project
    *before* the joins (a join of the raw sides would fan out), so the three
    joins are 1:1 on project_id and every list holds at most n entries.
    """
    o = (recent_outputs(outputs, max_outputs).groupBy("project_id")
         .agg(_ordered(["id", "goal", "next_actions", "blockers", "decisions", "files"], "outputs")))
    s = (recent_sessions(sessions, max_sessions).groupBy("project_id")
         .agg(_ordered(["id", "type", "summary", "next_action"], "sessions")))
    d = None
    if max_docs > 0:
        d = (recent_doc_summaries(documents, max_docs).groupBy("project_id")
             .agg(_ordered(["relative_path", "summary", "kind"], "docs")))
    empty = {
        "outputs": "array<struct<id:string,goal:string,next_actions:array<string>,blockers:array<string>,"
                   "decisions:array<string>,files:array<string>>>",
        "sessions": "array<struct<id:string,type:string,summary:string,next_action:string>>",
        "docs": "array<struct<relative_path:string,summary:string,kind:string>>",
    }
    p = projects.select(F.col("id").alias("project_id"), "name", "root_path", "summary", "active_goals")
    j = p.join(o, "project_id", "left").join(s, "project_id", "left")
    j = j.join(d, "project_id", "left") if d is not None else j.withColumn("docs", F.lit(None))
    for k, t in empty.items():
        j = j.withColumn(k, F.coalesce(F.col(k), F.array().cast(t)))
    return j


def document_counts(documents: DataFrame) -> DataFrame:
    """A1: documents per project (partial + final hash aggregate)."""
    return documents.groupBy("project_id").agg(F.count("*").alias("n_documents"))


def project_status(projects: DataFrame, documents: DataFrame, sessions: DataFrame, n_sessions: int = 3) -> DataFrame:
    """Per project its document count and newest sessions."""
    counts = document_counts(documents)
    recent = (recent_sessions(sessions, n_sessions).groupBy("project_id")
              .agg(_ordered(["type", "summary"], "recent_sessions")))
    p = projects.select(F.col("id").alias("project_id"), "name", "root_path", "summary", "active_goals")
    return (p.join(counts, "project_id", "left").join(recent, "project_id", "left")
            .withColumn("n_documents", F.coalesce("n_documents", F.lit(0).cast("bigint")))
            .withColumn("recent_sessions", F.coalesce(
                "recent_sessions", F.array().cast("array<struct<type:string,summary:string>>"))))
