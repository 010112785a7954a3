"""Clients that a caller brings: what the operators ask of them. All defaults work offline."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.paginate import chunk_number


class PageFetcher(Protocol):
    def __call__(self, url: str) -> str: ...


class TopicClient(Protocol):
    def __call__(self, title: str, body: str) -> list[tuple[str, list[str]]]: ...


class TranslateClient(Protocol):
    def __call__(self, texts: list[str], lang: str) -> list[str]: ...


def extract_topics(pages: DataFrame, client: TopicClient | None = None) -> DataFrame:
    """pages (id, title, body) -> (page, label, related): by a client, else the most frequent long words; empty labels go."""
    if client is None:
        from ..operators.graph import top_terms

        terms = top_terms(pages, "id", "body", 3)
        return terms.select(F.col("id").alias("page"), "label", F.array().cast("array<string>").alias("related"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, label, [r for r in related if r]) for i, t, b in zip(pdf["id"], pdf["title"], pdf["body"], strict=True) for label, related in client(t or "", b or "") if label.strip()]
            yield pd.DataFrame(rows, columns=["page", "label", "related"])

    return pages.select("id", "title", "body").mapInPandas(run, "page string, label string, related array<string>")


def submit_urls(urls: DataFrame, host: str, send=None, size: int = 10_000) -> DataFrame:
    """(batch, n, status) of addresses of one host sent in batches; send(host, urls) -> status code. Without send, nothing leaves and the status is null.

    Addresses of other hosts are left out. Batches are numbered over ranges of the sorted addresses.
    """
    from ..functions.paths import url_host
    from ..operators.ordering import global_rank

    own = urls.select("url").where(url_host(F.col("url")) == host.lower()).distinct()
    batches = global_rank(own, ["url"]).withColumn("batch", chunk_number(F.col("rank"), size)).groupBy("batch").agg(F.collect_list("url").alias("urls"))

    def run(it):
        import pandas as pd

        for pdf in it:
            status = [send(host, list(u)) if send else None for u in pdf["urls"]]
            yield pd.DataFrame({"batch": pdf["batch"], "n": [len(u) for u in pdf["urls"]], "status": pd.array(status, "Int32")})

    return batches.mapInPandas(run, "batch int, n long, status int")
