"""Paged history, feedback list, export and user lookups
(H1, H2, K6, P1-P6, J1-J3, O1-O6, A2).

A page is found by its keys.  The keys of the page window come first, from
scans that read key columns only; they are bounded by the window and pass
through the driver.  Everything else is fetched by literal ``IN`` lists that
reach the scan as pushed filters, texts last and only for the rows shown.
No text is shuffled or broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.predicates import all_of, in_range, on_days, optional_eq, own_rows, shown, ts_literal, verdict_filter

FEEDBACK_COLS = ["is_correct", "feedback_content", "feedback_time"]


@dataclass
class Page:
    """One page of rows plus the total the reference reports beside it."""
    rows: DataFrame
    total: DataFrame  # one row, column ``total``
    page: int
    page_size: int

    def total_count(self) -> int:
        return int(self.total.first()["total"])


def page_window(page: int = 1, page_size: int = S.PAGE_SIZE) -> tuple[int, int]:
    """(offset, rows needed) for a 1-based page."""
    if int(page) != page or page < 1:
        raise ValueError(f"page must be a positive integer, got {page!r}")
    if int(page_size) != page_size or page_size < 1:
        raise ValueError(f"page_size must be a positive integer, got {page_size!r}")
    offset = (int(page) - 1) * int(page_size)
    return offset, offset + int(page_size)


#: Keys that a page may pass through the driver.  A numbered page that ends
#: behind it is found by joins instead; a cursor never needs more than a page.
MAX_WINDOW = 10_000


def _key_frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Bounded key rows as a local relation."""
    return spark.createDataFrame(rows, schema)


#: Longer IN lists reach Parquet as one range only; short ones also meet its Bloom filters and dictionaries.
_SHORT_LIST, _SHORT_LISTS = 10, 50


def among(col: str, ids: Sequence) -> Column:
    """``col`` is one of ``ids``, in lists that the scan can check value by value."""
    ids = sorted(set(ids))
    if len(ids) > _SHORT_LIST * _SHORT_LISTS or not ids:
        return F.col(col).isin(ids)
    return reduce(or_, [F.col(col).isin(ids[i:i + _SHORT_LIST]) for i in range(0, len(ids), _SHORT_LIST)])


def _fetch(df: DataFrame, col: str, ids: Sequence, *cols: str) -> DataFrame:
    """The rows with the given ids, by a filter that the scan can push down."""
    return df.filter(among(col, ids)).select(*cols)


def _history_page(d: DataFrame, f: DataFrame, mine: DataFrame, offset: int, need: int, after: tuple | None = None) -> DataFrame:
    """Rows ``offset`` to ``need`` of the history of ``mine``, by keys.

    ``after`` = (id, feedback_id) drops the rows of that one detection up to
    and including that feedback.  A detection's feedback is cut to a per-task
    top-``need``, so a hot detection costs its keys, not a task.
    """
    spark = d.sparkSession
    top = (mine.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(need).select("id").collect())
    ids = [r["id"] for r in top]
    place = {i: k for k, i in enumerate(ids)}
    found: list[tuple[int, int]] = []
    if ids:
        keys = _fetch(f, "record_id", ids, "record_id", "id")
        if after is not None:
            a_id, a_fid = after
            keys = keys.filter((F.col("record_id") != F.lit(a_id)) | (F.col("id") < F.lit(a_fid))
                               if a_fid is not None else F.col("record_id") != F.lit(a_id))
        at = F.broadcast(_key_frame(spark, [(i, k) for i, k in place.items()], "record_id long, place int"))
        first = keys.join(at, "record_id").orderBy("place", F.col("id").desc()).limit(need)
        found = [(r["record_id"], r["id"]) for r in first.select("record_id", "id").collect()]
    by_id: dict[int, list] = {}
    for i, fid in found:
        by_id.setdefault(i, []).append(fid)
    # a detection whose feedback was all cut stands behind `need` rows already
    lonely = lambda i: [] if after is not None and i == after[0] else [None]
    page = [(n, i, fid) for n, (i, fid) in enumerate(
        (i, fid) for i in ids for fid in by_id.get(i) or lonely(i))][offset:need]
    keyed = _key_frame(spark, page, "_n int, id long, feedback_id long")
    fb = _fetch(f, "id", [x for _, _, x in page if x is not None], F.col("id").alias("feedback_id"), *FEEDBACK_COLS)
    # at most a page of feedback is broadcast; the texts are read where they are
    keyed = keyed.join(F.broadcast(fb), "feedback_id", "left")
    det = d.filter(among("id", [i for _, i, _ in page]))
    return (det.join(F.broadcast(keyed), "id").select(*shown(d), "feedback_id", *FEEDBACK_COLS, "_n")
            .orderBy("_n").limit(max(need - offset, 1)).drop("_n"))


def _history_deep(d: DataFrame, f: DataFrame, mine: DataFrame, offset: int, need: int) -> DataFrame:
    """The same page by joins on keys; nothing passes through the driver."""
    top = mine.select("created_at", "id").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(need)
    fk = f.select("record_id", F.col("id").alias("feedback_id"))
    order = [F.col("created_at").desc(), F.col("id").desc(), F.col("feedback_id").desc_nulls_last()]
    keys = top.join(fk, fk["record_id"] == top["id"], "left").select("id", "created_at", "feedback_id").orderBy(*order)
    keys = (keys.offset(offset) if offset else keys).limit(need - offset).select("id", "feedback_id")
    fb = f.select(F.col("id").alias("feedback_id"), *FEEDBACK_COLS)
    return (d.join(keys, "id").join(fb, "feedback_id", "left").select(*shown(d), "feedback_id", *FEEDBACK_COLS)
            .orderBy(*order).limit(need - offset))


def detection_history(d: DataFrame, f: DataFrame, user_id, page: int = 1,
                      page_size: int = S.PAGE_SIZE, keep_feedback_id: bool = False) -> Page:
    """A user's detections, newest first, one row per feedback (H1).

    Like the reference, the page counts joined rows while ``total`` counts
    the user's detections (Q3).  Ties on time are broken by detection id
    and feedback id, newest first.
    """
    offset, need = page_window(page, page_size)
    find = _history_page if need <= MAX_WINDOW else _history_deep
    rows = find(d, f, d.filter(own_rows(user_id)), offset, need)
    if not keep_feedback_id:
        rows = rows.drop("feedback_id")
    return Page(rows, history_total(d, user_id), page, page_size)


def history_total(d: DataFrame, user_id) -> DataFrame:
    """Detections of one user, not joined rows (A2)."""
    return d.filter(own_rows(user_id)).agg(F.count(F.lit(1)).alias("total"))


def history_after(d: DataFrame, f: DataFrame, user_id, cursor: tuple, page_size: int = S.PAGE_SIZE) -> DataFrame:
    """Keyset page: the ``page_size`` history rows after ``cursor`` =
    (created_at, id, feedback_id) of the last row already shown (O6).

    Cost does not grow with the page number: only detections at or after
    the cursor's key are considered, bounded by ``page_size + 1``.
    """
    if page_size < 1:
        raise ValueError("page_size must be positive")
    c_ts, c_id, c_fid = cursor
    ts = ts_literal(c_ts, d.schema["created_at"].dataType)  # text -> type: no zone involved
    before = (F.col("created_at") < ts) | ((F.col("created_at") == ts) & (F.col("id") < F.lit(c_id)))
    same = (F.col("created_at") == ts) & (F.col("id") == F.lit(c_id))
    mine = d.filter(all_of(own_rows(user_id), before | same, on_days(d, "created_at", last=c_ts)))
    # one detection more: the cursor's own may have nothing left
    return _history_page(d, f, mine, 0, page_size + 1, after=(c_id, c_fid)).limit(page_size)


def feedback_filter(f: DataFrame, verdict: str = "all", start=None, end=None, user_id=None) -> Column:
    """The list's optional conditions, AND-ed."""
    return all_of(verdict_filter(verdict), in_range(f, "feedback_time", start, end),
                  optional_eq("user_id", user_id))


def _feedback_keys(fsel: DataFrame, d: DataFrame, need: int) -> list:
    """Keys of the first ``need`` feedback rows that have a detection, newest first.

    Feedback refers to stored detections, so the newest rows nearly always
    do: their keys are read by a per-task top-N and checked by a pushed
    ``IN`` on the detections.  Where many are orphans, windows of tenfold size
    follow, and then a semi join on the keys of all.
    """
    order = [F.col("feedback_time").desc(), F.col("id").desc()]
    keys = fsel.select("record_id", "feedback_time", "id")
    size, rest, got = need + S.PAGE_SIZE, keys, []
    for _ in range(3):
        window = rest.orderBy(*order).limit(size).collect()
        refs = sorted({r["record_id"] for r in window if r["record_id"] is not None})
        known = {r["id"] for r in _fetch(d, "id", refs, "id").distinct().collect()} if refs else set()
        got += [r for r in window if r["record_id"] in known]
        if len(got) >= need or len(window) < size:
            return got[:need]
        if size * 10 > MAX_WINDOW:
            break
        rest, size = keys.filter(_older(keys, window[-1]["feedback_time"], window[-1]["id"])), size * 10
    return (keys.join(d.select(F.col("id").alias("record_id")), "record_id", "left_semi")
            .orderBy(*order).limit(need).collect())


def _older(f: DataFrame, time, fid) -> Column:
    ts = ts_literal(time, f.schema["feedback_time"].dataType)
    return all_of((F.col("feedback_time") < ts) | ((F.col("feedback_time") == ts) & (F.col("id") < F.lit(fid))), on_days(f, "feedback_time", last=time))


def _feedback_rows(f: DataFrame, d: DataFrame, keys: list) -> DataFrame:
    """The feedback rows of a page of keys with their detection's columns."""
    keyed = F.broadcast(_key_frame(f.sparkSession, [(n, r["id"]) for n, r in enumerate(keys)], "_n int, _fid long"))
    fb = f.filter(among("id", [r["id"] for r in keys])).join(keyed, F.col("id") == F.col("_fid")).drop("_fid")
    det = _fetch(d, "id", [r["record_id"] for r in keys], F.col("id").alias("_det"), "text_content", "bias_type", "confidence")
    # at most a page of feedback is broadcast; the texts are read where they are
    return (det.join(F.broadcast(fb), F.col("record_id") == F.col("_det"))
            .select(*shown(f), "text_content", "bias_type", "confidence", "_n")
            .orderBy("_n").limit(max(len(keys), 1)).drop("_n"))


def _feedback_deep(fsel: DataFrame, d: DataFrame, offset: int, page_size: int) -> DataFrame:
    """The same page by joins on keys; nothing passes through the driver."""
    order = [F.col("feedback_time").desc(), F.col("id").desc()]
    keys = fsel.select("record_id", "feedback_time", "id").join(
        d.select(F.col("id").alias("record_id")), "record_id", "left_semi").orderBy(*order).offset(offset).limit(page_size)
    det = d.select(F.col("id").alias("record_id"), "text_content", "bias_type", "confidence")
    page = fsel.join(keys.select("id"), "id", "left_semi")
    return (page.join(det, "record_id").select(*shown(fsel), "text_content", "bias_type", "confidence")
            .orderBy(*order).limit(page_size))


def feedback_list(f: DataFrame, d: DataFrame, verdict: str = "all", start=None, end=None,
                  user_id=None, page: int = 1, page_size: int = S.PAGE_SIZE) -> Page:
    """Feedback with its detection's text, label and confidence, newest first (H2)."""
    offset, need = page_window(page, page_size)
    fsel = f.filter(feedback_filter(f, verdict, start, end, user_id))
    if need <= MAX_WINDOW:
        rows = _feedback_rows(f, d, _feedback_keys(fsel, d, need)[offset:])
    else:
        rows = _feedback_deep(fsel, d, offset, page_size)
    total = fsel.agg(F.count(F.lit(1)).alias("total"))  # Q4: counted without the join
    return Page(rows, total, page, page_size)


def feedback_after(f: DataFrame, d: DataFrame, cursor: tuple, page_size: int = S.PAGE_SIZE,
                   verdict: str = "all", start=None, end=None, user_id=None) -> DataFrame:
    """Keyset page: the ``page_size`` feedback rows after ``cursor`` =
    (feedback_time, id) of the last row already shown (O6).  Cost does not
    grow with the page number."""
    if page_size < 1:
        raise ValueError("page_size must be positive")
    fsel = f.filter(feedback_filter(f, verdict, start, end, user_id) & _older(f, *cursor))
    return _feedback_rows(f, d, _feedback_keys(fsel, d, page_size))


def feedback_total(f: DataFrame, verdict: str = "all", start=None, end=None, user_id=None) -> DataFrame:
    """Feedback rows under the list's filters (A2)."""
    return f.filter(feedback_filter(f, verdict, start, end, user_id)).agg(F.count(F.lit(1)).alias("total"))


EXPORT_COLS = ["id", "record_id", "is_correct", "feedback_content", "feedback_time",
               "text_content", "bias_type", "is_biased", "confidence", "username"]


def export_feedback(f: DataFrame, d: DataFrame, u: DataFrame) -> DataFrame:
    """Every feedback row with its detection and its author's name,
    newest first (K6, J3, P3, O2).  Sort-merge joins (AQE broadcasts a side
    that turns out small and splits hot keys)."""
    fa, ra, ua = f.alias("f"), d.alias("r"), u.alias("u")
    # authors first: the detection text then crosses one shuffle, not two
    return (fa.join(ua, F.col("f.user_id") == F.col("u.id"))
            .join(ra, F.col("f.record_id") == F.col("r.id"))
            .select(F.col("f.id").alias("id"), "f.record_id", "f.is_correct", "f.feedback_content",
                    "f.feedback_time", "r.text_content", "r.bias_type", "r.is_biased",
                    "r.confidence", "u.username")
            .orderBy(F.col("feedback_time").desc(), F.col("id").desc()))


def write_export(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write an export as json lines, csv (with header) or parquet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(fmt).save(path)


PUBLIC_USER_COLS = ["id", "username", "role", "created_at", "last_login"]


def user_by_id(users: DataFrame, user_id) -> DataFrame:
    """Public columns of one user (P5); a users table without them is an error."""
    return users.filter(F.col("id") == F.lit(user_id)).select(*PUBLIC_USER_COLS)


def user_by_name(users: DataFrame, name: str) -> DataFrame:
    """A user by name under the accounts' collation: case, accents and
    trailing blanks are ignored (P6)."""
    return users.filter(F.collate("username", S.NAME_COLLATION) == F.lit(name)).select(*PUBLIC_USER_COLS)
