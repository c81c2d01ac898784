"""Admission in order under quotas by kind and caps by document and page, without passing the rows through the driver.

What is accepted depends on what was accepted before, but a kind, a document or a page that is full stays full. So the
driver takes the next ``BLOCK`` rows that nothing full rejects, decides these one after another, and asks again for the
rows after them with what is full by then; the rows between are rejected where they lie. The first row of a block is
always accepted, so there are at most as many rounds as the quotas' sum, and the driver holds a block, and what
was accepted. Each row's rule then follows from when its kind, documents and pages became full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 10_000
PLACES = "array<struct<document_id:string,page:int>>"


class Filled:
    """When (by ``ord``) kinds, documents and pages became full; what was accepted."""

    def __init__(self) -> None:
        self.kinds: dict[str, int] = {}
        self.documents: dict[str, int] = {}
        self.pages: dict[tuple[str, int], int] = {}
        self.accepted: list[int] = []

    def row(self, spark, quotas: dict[str, int]) -> DataFrame:
        """One row of maps; a kind without a quota was full from the start."""
        kinds = [(k, self.kinds.get(k)) for k, q in quotas.items() if q > 0]
        pages = {_page(*p): at for p, at in self.pages.items()}
        return F.broadcast(spark.createDataFrame([(dict(kinds), dict(self.documents), pages)], "full_kinds map<string,long>, full_documents map<string,long>, full_pages map<string,long>"))


def _page(document: str | None, page: int | None) -> str:
    return f"{page}:{document}"


def admission(rows: DataFrame, quotas: dict[str, int], per_document: int | None, per_page: int | None, block: int = BLOCK) -> Filled:
    """Decide ``rows`` (ord long, kind string, places PLACES) in the order of ``ord``, which is unique."""
    spark, out, cursor = rows.sparkSession, Filled(), None
    kinds: dict[str, int] = {}
    documents: dict[str, int] = {}
    pages: dict[tuple[str, int], int] = {}
    while True:
        left = rejected(rows, out, quotas, spark).where("rule is null").select("ord", "kind", "places")
        take = (left if cursor is None else left.where(F.col("ord") > cursor)).orderBy("ord").limit(block).collect()
        for r in take:
            places = {(p["document_id"] or "", p["page"]) for p in r["places"] or []}
            held = {d for d, _ in places}
            if r["kind"] in out.kinds or any(d in out.documents for d in held) or any(p in out.pages for p in places):
                continue
            out.accepted.append(r["ord"])
            kinds[r["kind"]] = kinds.get(r["kind"], 0) + 1
            if kinds[r["kind"]] >= quotas[r["kind"]]:
                out.kinds[r["kind"]] = r["ord"]
            for own, most, used, full in ((held, per_document, documents, out.documents), (places, per_page, pages, out.pages)):
                for x in own if most is not None else ():
                    used[x] = used.get(x, 0) + 1
                    if used[x] >= most:
                        full[x] = r["ord"]
        if len(take) < block:
            return out
        cursor = take[-1]["ord"]


def rejected(rows: DataFrame, filled: Filled, quotas: dict[str, int], spark) -> DataFrame:
    """``rows`` with ``rule``: what rejects them, null for accepted ones."""
    before = lambda full: F.coalesce(full < F.col("ord"), F.lit(False))
    known = F.map_contains_key("full_kinds", F.coalesce("kind", F.lit("")))
    places = F.coalesce("places", F.array().cast(PLACES))
    page = lambda p: F.concat(F.coalesce(p["page"].cast("string"), F.lit("None")), F.lit(":"), F.coalesce(p["document_id"], F.lit("")))
    rule = (
        F.when(~known | F.col("kind").isNull() | before(F.try_element_at("full_kinds", F.coalesce("kind", F.lit("")))), "type_quota_exceeded")
        .when(F.exists(places, lambda p: before(F.try_element_at(F.col("full_documents"), F.coalesce(p["document_id"], F.lit(""))))), "per_document_cap_exceeded")
        .when(F.exists(places, lambda p: before(F.try_element_at(F.col("full_pages"), page(p)))), "per_page_cap_exceeded")
    )
    return rows.crossJoin(filled.row(spark, quotas)).withColumn("rule", rule).drop("full_kinds", "full_documents", "full_pages")  # one row of maps
