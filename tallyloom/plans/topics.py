"""Topic models over texts; assignment, components, weighted scores and tails."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyloom.functions.vectors import top_index, top_indices
from tallyloom.operators import components, counts, entities, patterns, topic_sweep, topics
from tallyloom.plans.language import prepared, scored_texts
from tallyloom.plans.registry import query, steady
from tallyloom.plans.views import Tables, texts, vectors
from tallyloom.storage import cut_lineage, written

TOPICS = 12
RUN_SUPPORT = 0.02


def text_frame(t: Tables):
    """Texts with their free words."""
    return prepared(t).select("id", "language", "stopWordFree")


def fitted(t: Tables, n: int = 2, k: int = TOPICS):
    # cut into words once, for the fit and for the weights
    frame = written(text_frame(t), "texts")
    return topics.fit_topics(frame, "stopWordFree", k, n=n, size=10_000, held=True), frame


def with_topics(t: Tables):
    model, frame = fitted(t)
    # written once: each of their readers looks at all entries, some more than once
    return written(model.topic_weights(frame, "id", "language"), "topic-weights")


def topic_sentiment(t: Tables):
    """(id, language, topic, weighted): topic weights times the hybrid score."""
    joined = with_topics(t).join(scored_texts(t).select("id", "hybrid"), "id")
    return topics.weighted_scores(joined, "weights", "hybrid", "id", "language")


def tail_texts(t: Tables):
    """Texts in the tails of each topic. Only the texts of tail rows are joined.

    The scores feed both the bounds and the filter, so they are written once
    instead of scoring all texts twice.
    """
    found = topics.tails(cut_lineage(topic_sentiment(t)), "topic", "weighted")
    return found.join(texts(t).select("id", "text"), "id")


@query("lda_topics")
def lda_topics(t: Tables):
    """Topic weights of every text."""
    return with_topics(t).select("id", F.posexplode("weights").alias("topic", "weight"))


@query("topic_terms")
def topic_terms(t: Tables):
    """The ten heaviest word pairs of each topic."""
    return topics.topic_terms(fitted(t)[0], 10)


@query("lda_sweep")
def lda_sweep(t: Tables):
    """Likelihood and perplexity for word runs of one to three words and two to thirteen topics."""
    return topic_sweep.sweep(text_frame(t), "stopWordFree", [1, 2, 3], list(range(2, 14)), max_iter=20, size=10_000)


@query("topic_assign")
def topic_assign(t: Tables):
    """First topic and first three topics of every text, and the size of each topic."""
    a = topics.assign(with_topics(t), F.col("weights"))
    return a.select("id", "top_topic", F.array_join("top_topics", ",").alias("top_topics"))


@query("topic_share")
def topic_share(t: Tables):
    """Texts per first topic with their fraction."""
    return counts.share_of_total(topics.assign(with_topics(t), F.col("weights")), "top_topic")


@query("topk_vector_index", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS top1,
  array_to_string(list_transform(list_sort(list_transform(range(1, len(embedding) + 1),
    lambda i: {'v': -embedding[i], 'i': i - 1}))[1:3], lambda s: s.i), ',') AS top3 FROM embeddings""")
def topk_vector_index(t: Tables):
    """Places of the greatest and of the three greatest entries of each vector."""
    v = F.col("embedding")
    return vectors(t).select("vec_id", top_index(v).alias("top1"), F.array_join(top_indices(v, 3), ",").alias("top3"))


@query("cluster_centroids", """
WITH flat AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label, CAST(dim AS INT) AS dim, CAST(round(TRY_CAST(avg(CAST(v AS DOUBLE)) AS DECIMAL(28,9)), 6) AS DOUBLE) AS mean FROM flat GROUP BY 1, 2
UNION ALL SELECT NULL, CAST(dim AS INT), CAST(round(TRY_CAST(avg(CAST(v AS DOUBLE)) AS DECIMAL(28,9)), 6) AS DOUBLE) FROM flat GROUP BY 2""")
def cluster_centroids(t: Tables):
    """Mean vector of each cluster and of all rows."""
    return topics.centroids(vectors(t), "label", "embedding").withColumn("mean", steady("mean", 6))


@query("pca_2d")
def pca_2d(t: Tables):
    """Two components of the scaled vectors beside the cluster."""
    v = vectors(t).select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return components.components(v, "features")[0].drop("features")


@query("topic_weighted_score")
def topic_weighted_score(t: Tables):
    """Topic weights times the sentiment of the text, in long form."""
    return topic_sentiment(t)


@query("vector_weighted_score", """
WITH flat AS (SELECT vec_id, label, embedding AS e, generate_subscripts(embedding, 1) - 1 AS dim,
  unnest(embedding) AS v FROM embeddings)
SELECT vec_id, CAST(dim AS INT) AS dim, CAST(v AS DOUBLE) * label + 0.0 AS weighted FROM flat""")
def vector_weighted_score(t: Tables):
    """The same product for given vectors."""
    w = topics.weighted_scores(vectors(t), "embedding", "label", "vec_id", topic="dim")
    return w.withColumn("weighted", F.col("weighted") + 0.0)


TAILS = """WITH flat AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
bound AS (SELECT dim, avg(v) AS m, stddev_samp(v) AS s FROM flat GROUP BY 1),
tail AS (SELECT f.vec_id, f.dim, CASE WHEN v > m + 2 * s THEN 'positive' ELSE 'negative' END AS tail
  FROM flat f JOIN bound b ON b.dim = f.dim WHERE v > m + 2 * s OR v < m - 2 * s)"""


def vector_tails(t: Tables):
    flat = vectors(t).select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "v"))
    return topics.tails(flat, "dim", "v")


@query("vector_tails", TAILS + " SELECT vec_id, CAST(dim AS INT) AS dim, tail FROM tail")
def vector_tails_query(t: Tables):
    """Rows beyond two deviations of their dimension, all dimensions in one pass."""
    return vector_tails(t).select("vec_id", "dim", "tail")


@query("tail_only_terms", TAILS + """,
terms AS (SELECT DISTINCT dim, tail, source FROM tail JOIN documents ON vec_id = doc_id)
SELECT CAST(dim AS INT) AS dim, source, tail FROM terms n WHERE NOT EXISTS (
  SELECT 1 FROM terms p WHERE p.dim = n.dim AND p.source IS NOT DISTINCT FROM n.source AND p.tail <> n.tail)""")
def tail_only_terms(t: Tables):
    """Terms of each tail that the other tail of the same dimension lacks, both sides in one pass."""
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "source")
    found = vector_tails(t).join(docs, "vec_id")
    return counts.exclusive_terms(found, "tail", "dim", "source").select("dim", "source", "tail")


@query("topic_tail_entities")
def topic_tail_entities(t: Tables):
    """Names in the texts of each topic's tails, all topics in one pass."""
    return entities.entity_counts(tail_texts(t), "text", "topic", "tail", "language")


@query("topic_tail_only_entities")
def topic_tail_only_entities(t: Tables):
    """Names found in one tail of a topic only, with that tail."""
    found = entities.entities(tail_texts(t), "text", "topic", "tail")
    return counts.exclusive_terms(found, "tail", "topic", "entity").select("topic", "entity", "tail")


@query("topic_tail_trigrams")
def topic_tail_trigrams(t: Tables):
    """Closed frequent sets of three-word runs in each tail of each topic."""
    marked = tail_texts(t).withColumn("place", F.concat_ws(":", F.col("topic").cast("string"), "tail"))
    runs = patterns.run_baskets(marked, "text", 3, "place")
    sets = patterns.closed_sets(runs, "place", "items", RUN_SUPPORT)
    place = F.split("place", ":")
    return sets.select(
        place[0].cast("int").alias("topic"), place[1].alias("tail"), F.array_join("items", "|").alias("items"), "size", "freq"
    )
