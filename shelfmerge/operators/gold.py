"""Best listing per (isbn, site) and the golden record per isbn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmerge.functions.text import filled, is_blank

#: Weight of each field in the completeness score; binding and category carry none.
WEIGHTS = {
    "titulo": 10, "autor": 10, "editorial": 8, "sinopsis": 20, "idioma": 5, "paginas": 5, "dimensiones": 5,
    "fecha_publicacion": 5, "url_portada": 4,
}
#: Whose value a field of the golden record takes first; any site's after these.
PRIORITY = {
    **{f: ["yenny", "el_lector"] for f in ("titulo", "autor", "editorial", "sinopsis")},
    **{
        f: ["el_lector", "yenny"]
        for f in ("idioma", "paginas", "dimensiones", "fecha_publicacion", "url", "url_portada")
    },
}


def completeness_score(weights: dict[str, int] = WEIGHTS) -> Column:
    total = F.lit(0)
    for field, weight in weights.items():
        total = total + F.when(is_blank(F.col(field)), 0).otherwise(weight)
    return total


def listing_best(std: DataFrame) -> DataFrame:
    """The top row of each (isbn, site): fullest, then latest, then smallest url.

    Rows without an isbn are dropped first: they are no item, and would be one
    giant group. Dealt by isbn, so the golden record needs no further shuffle.
    """
    order = Window.partitionBy("isbn", "site").orderBy(
        F.desc("score"), F.desc(F.coalesce("updated_at", F.timestamp_seconds(F.lit(0)))), "url"
    )
    scored = std.filter(~is_blank(F.col("isbn"))).withColumn("score", completeness_score())
    return scored.repartition("isbn").withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def master(best: DataFrame, priority: dict[str, list[str]] = PRIORITY) -> DataFrame:
    """One row per isbn: each field from its first site that has it, then the greatest of any site."""
    fields = []
    for field, sites in priority.items():
        choices = [F.max(F.when(F.col("site") == s, filled(F.col(field)))) for s in sites]
        fields.append(F.coalesce(*choices, F.max(filled(F.col(field)))).alias(field.upper()))
    return best.groupBy(F.col("isbn").alias("ISBN")).agg(*fields).withColumn("SITE", F.lit("master"))
