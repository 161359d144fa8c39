"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import pii
from turnstile.llm.common import table
from turnstile.llm.decontam import Decontamination
from turnstile.llm.fingerprints import fingerprints
from turnstile.llm.licenses import LicenseScan
from turnstile.llm.linededup import LineDedup
from turnstile.llm.mixing import mix
from turnstile.llm.neardup import NearDuplicates
from turnstile.llm.neighbours import LearnedPartitions
from turnstile.llm.pages import main_texts
from turnstile.llm.search import MaxSketchIndex
from turnstile.llm.tokens import count_tokens
from turnstile.llm.toxicity import corpus_chain, score
from turnstile.llm.trie import PrefixTrie, numbered, rebuilt

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_licenses(spark, sf_dir):
    """License notices that each document holds."""
    return LicenseScan(table(spark, sf_dir, "documents")).report()


@query
def op2_token_counts(spark, sf_dir):
    """Tokens of each document, before and after three edits of it: a cut, a change and an addition."""
    docs = table(spark, sf_dir, "documents")
    size = F.length(F.coalesce("text", F.lit("")))

    def change(start, length, new):
        return F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("end"),
                        new.alias("new"))

    edits = F.array(
        change(F.floor(size / 5), F.lit(40), F.lit("")),
        change(F.floor(size / 2), F.lit(12), F.concat(F.lit(" "), F.coalesce("source", F.lit("")))),
        change(size, F.lit(0), F.coalesce("lang", F.lit(""))))
    return count_tokens(docs.withColumn("edits", edits), Path(VOCABULARY).read_bytes())


@query
def op3_main_text(spark, sf_dir):
    """Main text of every page."""
    return main_texts(table(spark, sf_dir, "pages"))


@query
def op4_pii(spark, sf_dir):
    """Personal data in every document: the rules' spans and those that the tagger adds."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


@query
def op5_line_dedup(spark, sf_dir):
    """Lines of each document that go because an earlier line is (nearly) the same."""
    return LineDedup(table(spark, sf_dir, "documents")).report()


ORACLE["op5_line_dedup"] = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), numbered AS (
    SELECT doc_id, i - 1 AS line, regexp_extract_all(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM split)
), tokens AS (
    SELECT DISTINCT doc_id, line, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS t
    FROM (SELECT doc_id, line, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i
          FROM numbered WHERE len(w) > 0)
), sets AS (
    SELECT doc_id, line, count(*) AS k, string_agg(t, chr(10) ORDER BY t) AS s
    FROM tokens GROUP BY doc_id, line
), classes AS (
    SELECT s, min(k) AS k, min((doc_id, line)) AS first FROM sets GROUP BY s
), members AS (
    SELECT c.s, c.k, c.first, t.t FROM classes c
    JOIN tokens t ON t.doc_id = c.first[1] AND t.line = c.first[2]
), matches AS (
    SELECT y.s FROM members x JOIN members y ON x.t = y.t AND x.first < y.first
    GROUP BY x.s, y.s, x.k, y.k HAVING 100 * count(*) >= 80 * (x.k + y.k - count(*))
), removed AS (
    SELECT doc_id, line FROM sets JOIN classes USING (s)
    WHERE (doc_id, line) != first OR s IN (SELECT s FROM matches)
), lists AS (
    SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines
    FROM removed GROUP BY doc_id
)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed,
       coalesce(lines, '') AS removed_lines
FROM split LEFT JOIN lists USING (doc_id)
"""


@query
def op6_decontamination(spark, sf_dir):
    """Words of each document inside occurrences of benchmark windows, and their items."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return Decontamination(docs, items).report()


ORACLE["op6_decontamination"] = r"""
WITH folded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_at AS (
    SELECT item_id, w, least(len(w), 10) AS size,
           unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i
    FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM item_at
), sizes AS (
    SELECT DISTINCT size FROM windows
), doc_at AS (
    SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
    FROM folded, sizes WHERE len(w) >= size
), hits AS (
    SELECT doc_id, item_id, i, d.size
    FROM doc_at d JOIN windows k
      ON d.size = k.size AND array_to_string(d.w[d.i:d.i + d.size - 1], ' ') = k.words
), hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hits) GROUP BY doc_id
)
SELECT f.doc_id, len(f.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query
def op7_mixing(spark, sf_dir):
    """Words that a mix of 150% of all words takes from each document."""
    return mix(table(spark, sf_dir, "documents")).taken()


@query
def op8_toxicity(spark, sf_dir):
    """Probabilities of the chain for each document, and whether it is rejected."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = corpus_chain(docs, labels)
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") > chain.cuts[-1])


@query
def op9_fingerprints(spark, sf_dir):
    """Sketches of every document and of its edited text, and how alike they are."""
    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op10_neardup(spark, sf_dir):
    """Components of documents that share four fifths of their two-word shingles."""
    return NearDuplicates(table(spark, sf_dir, "documents"), size=2, percent=80).report()


ORACLE["op10_neardup"] = r"""
WITH RECURSIVE folded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, w[i] || ' ' || w[i + 1] AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM folded WHERE len(w) > 1)
        UNION ALL SELECT doc_id, w[1] FROM folded WHERE len(w) = 1)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) e
      ON e.a = r.other
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id,
       d.doc_id = min(other) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
GROUP BY d.doc_id
"""


@query
def op11_search(spark, sf_dir):
    """The 50 best documents of each benchmark item, by exact scores."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return MaxSketchIndex(docs).search(items, k=50)


ORACLE["op11_search"] = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (
    SELECT row_number() OVER () AS d, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0
), corpus AS (
    SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), tf AS (
    SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) GROUP BY d, t
), df AS (
    SELECT t, count(*) AS df FROM tf GROUP BY t
), query AS (
    SELECT q, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
    FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)
), weighed AS (
    SELECT q, item_id, t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM query JOIN df USING (t), corpus
), scores AS (
    SELECT q, item_id, doc_id, sum(weighed.w * ((1000000000 * tf)
        // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM weighed JOIN tf USING (t) JOIN docs USING (d), corpus GROUP BY q, item_id, d, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank
    FROM scores WHERE score > 0)
WHERE rank <= 50
"""


@query
def op12_trie(spark, sf_dir):
    """Nodes of the trie of rebuilt conversations, with totals of their subtrees."""
    return PrefixTrie(*rebuilt(numbered(table(spark, sf_dir, "conversations")))).report()


# CRC-32 bit by bit: a byte is put in, then shifted out in eight steps (-1).
ORACLE["op12_trie"] = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
    SELECT conv_id, k, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos
    FROM given
), steps AS (
    SELECT conv_id, count(*) AS n, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
        lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS s
    FROM turns GROUP BY conv_id
), own AS (
    SELECT conv_id, n, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, s), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
            WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 4 AS h
    FROM steps
), convs AS (
    SELECT o.conv_id, o.base, o.h, least(o.h, coalesce(b.n, 0)) AS head FROM own o LEFT JOIN own b ON b.conv_id = o.base
), rebuilt AS (
    SELECT c.conv_id, t.pos AS d, t.k, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, t.pos - c.h + c.head, t.k, t.text
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), paths AS (
    SELECT conv_id, d, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
    UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), nodes AS (
    SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY path, d
), children AS (
    SELECT p.path, p.conv_id AS parent, c.path AS child FROM nodes c JOIN nodes p
    ON p.d = c.d - 1 AND p.path = c.path[:32 * (c.d - 1)]
), below AS (
    SELECT DISTINCT a.path AS top, b.path FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.d <= b.d
), totals AS (
    SELECT top, count(*) FILTER (path NOT IN (SELECT path FROM children)) AS n_leaves,
           sum((n_convs - 1) * words) AS saved FROM below JOIN nodes USING (path) GROUP BY top
), ends AS (
    SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, max_by(path, d) AS path FROM paths GROUP BY conv_id) GROUP BY path
)
SELECT n.conv_id, n.d::BIGINT AS depth, up.parent AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(k.n, 0)::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN totals t ON t.top = n.path LEFT JOIN children up ON up.child = n.path
LEFT JOIN (SELECT path, count(*) AS n FROM children GROUP BY path) k ON k.path = n.path
LEFT JOIN ends e ON e.path = n.path
"""


@query
def op13_neighbours(spark, sf_dir):
    """The five nearest vectors found for every vector whose id is divisible by 50."""
    return LearnedPartitions(table(spark, sf_dir, "embeddings")).search(F.col("vec_id") % 50 == 0)
