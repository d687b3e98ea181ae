"""The registered queries of this package and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.llm import bpe, merkle, pii, repair, toxicity, urls
from weirworks.llm.common import table
from weirworks.llm.forest import neighbours
from weirworks.llm.jaccard import near_copies
from weirworks.llm.line_dedup import dedup_lines
from weirworks.llm.mixing import mix
from weirworks.llm.quality import resample
from weirworks.llm.repeats import without_repeats
from weirworks.llm.threshold import top_scores
from weirworks.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def sha(column: str):
    """Lower-case hex SHA-256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(column), F.lit("")), 256)


LINE_SQL = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM parts
), keys AS (
  SELECT doc_id, line, pos, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM keyed
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keys WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), kept AS (
  SELECT k.doc_id, k.line, k.pos, f.first_doc IS NOT NULL AND k.doc_id > f.first_doc AS gone
  FROM keys k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""


@query("op4_line_dedup", LINE_SQL)
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    clean = dedup_lines(table(spark, folder, "documents"), counts=("n_lines", "n_dropped"))
    return clean.select("doc_id", "n_lines", "n_dropped", sha("text").alias("kept_sha256"))


# The draw repeats the operator's definitions: MD5 bits to an exponential key, exact running sums per source.
MIX_SQL = r"""
WITH spaced AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
    trim(translate(coalesce(text, ''), concat(chr(9), chr(10), chr(11), chr(12), chr(13)), '     '), ' ') AS flat
  FROM documents
), drawn AS (
  SELECT doc_id, source, CASE WHEN flat = '' THEN 0 ELSE len(regexp_split_to_array(flat, ' +')) END AS size,
    -ln((CAST(concat('0x', substr(md5(concat('mix', CAST(doc_id AS VARCHAR))), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0)
      / CASE WHEN length(body) = 0 THEN 0.25 ELSE 1.0 - 0.75 * (length(body)
        - length(translate(body, '#$%&*!<>{}[]|\~^_=+@0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) / length(body) END AS draw
  FROM spaced
), sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM drawn GROUP BY source
), ranked AS (
  SELECT *, 2.0 * source_size AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM sources
), levels AS (
  SELECT *, most / weight AS full_at, (1.5 * sum(source_size) OVER ()
      - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), found AS (
  SELECT level AS final FROM levels WHERE level <= full_at ORDER BY full_at, level LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN (SELECT final FROM found) IS NULL THEN most
    ELSE least(most, weight * (SELECT final FROM found)) END AS target FROM ranked
), budgets AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE least(floor(target / source_size), 2) END AS whole FROM targets
), summed AS (
  SELECT d.*, b.source_size, b.target, b.whole, greatest(0, b.target - b.whole * b.source_size) AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle
  FROM drawn d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * CASE WHEN whole >= 2 THEN 2 ELSE whole + CASE WHEN budget > 0 AND middle <= budget THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM summed
"""


@query("op5_mixing", MIX_SQL)
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_bpe")
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    decoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path(), decoded="decoded")
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


def toxicity_model(spark: SparkSession, docs: DataFrame, folder: str) -> toxicity.Model:
    """Learned from three quarters of the labels; the others are there to measure it."""
    labels = table(spark, folder, "labels")
    return toxicity.learn(docs, labels.where(~held_out("doc_id")))


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.with_scores(docs, toxicity_model(spark, docs, folder))
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted)


@query("op9_neighbours")
def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


TOP_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op10_top_scores", TOP_SQL)
def op10_top_scores(spark: SparkSession, folder: str) -> DataFrame:
    return top_scores(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op1_pii")
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), runs AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
    ELSE [array_to_string(w, ' ')] END) AS run FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS size FROM runs GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id
  JOIN sizes sa ON sa.doc_id = a.doc_id JOIN sizes sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING count(*) / (any_value(sa.size) + any_value(sb.size) - count(*)) >= 0.8
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT r.node AS doc_id, min(r.seen) AS class_id, CAST(coalesce(any_value(c.n), 0) AS BIGINT) AS n_links
FROM reach r LEFT JOIN counts c ON c.a = r.node GROUP BY r.node
"""


@query("op3_jaccard_join", JACCARD_SQL)
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents"), every_row=True)


@query("op8_quality")
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_repeats")
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    out = without_repeats(table(spark, folder, "documents"))
    gone = F.aggregate(F.zip_with("start", "stop", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, n: s + n)
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("start").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


URL_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]


def url_sql() -> str:
    """The rules from the longest on, the counts of both models, chances by length of context, and the least score."""

    def rule(value) -> str:
        cases = [
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'"
            for r in sorted(URL_RULES, key=lambda r: -len(r.shown))
        ]
        return f"CASE {' '.join(cases)} END"

    def grams(text: str) -> str:
        return f"""unnest(list_transform(range(6, length({text}) + 7), lambda i:
            substr(concat(repeat(chr(2), 5), {text}, chr(3)), i - 5, 6)))"""

    def chance(seen: str, below: str) -> str:
        return f"""CASE WHEN coalesce(all_{seen}, 0) > 0 THEN (coalesce({seen}, 0) + kinds_{seen} * CAST({below} AS DOUBLE))
            / CAST(all_{seen} + kinds_{seen} AS DOUBLE) ELSE CAST({below} AS DOUBLE) END"""

    levels = [f"level1 AS (SELECT gram, {chance('yes', '1 / 256.0')} AS p, {chance('no', '1 / 256.0')} AS q FROM known WHERE length(gram) = 1)"]
    levels += [
        f"""level{n} AS (SELECT k.gram, {chance('yes', 'b.p')} AS p, {chance('no', 'b.q')} AS q
            FROM known k JOIN level{n - 1} b ON b.gram = right(k.gram, {n - 1}) WHERE length(k.gram) = {n})"""
        for n in range(2, 7)
    ]
    return rf"""
WITH parts AS (
  SELECT row_number() OVER () AS id, page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages
), told AS (
  SELECT *, {rule(lambda r: r.shown)} AS rule, {rule(lambda r: r.verdict)} AS said,
    concat(host, path) AS body, left(md5(concat(host, path)), 1) < '4' AS held_out FROM parts
), train AS (
  SELECT DISTINCT body, said = 'allow' AS accepted FROM told WHERE said IS NOT NULL AND NOT held_out
), spelled AS (
  SELECT {grams("body")} AS gram, accepted FROM train
), endings AS (
  SELECT right(gram, k) AS gram, accepted FROM spelled, (SELECT unnest(range(1, 7)) AS k)
), counts AS (
  SELECT gram, count(*) FILTER (WHERE accepted) AS yes, count(*) FILTER (WHERE NOT accepted) AS no FROM endings GROUP BY gram
), contexts AS (
  SELECT left(gram, length(gram) - 1) AS context, sum(yes) AS all_yes, count(*) FILTER (WHERE yes > 0) AS kinds_yes,
    sum(no) AS all_no, count(*) FILTER (WHERE no > 0) AS kinds_no FROM counts GROUP BY 1
), spots AS (
  SELECT id, {grams("body")} AS gram FROM told WHERE said IS NULL OR held_out
), needed AS (
  SELECT DISTINCT right(gram, k) AS gram FROM (SELECT DISTINCT gram FROM spots), (SELECT unnest(range(1, 7)) AS k)
), known AS (
  SELECT n.gram, c.yes, c.no, x.* EXCLUDE (context) FROM needed n LEFT JOIN counts c ON c.gram = n.gram
  LEFT JOIN contexts x ON x.context = left(n.gram, length(n.gram) - 1)
), {", ".join(levels)}, scored AS (
  SELECT id, CAST(floor(sum(CAST(floor((ln(p) - ln(q)) * 1000000 + 0.5) AS BIGINT)) / (count(*) * 1000.0)) AS BIGINT) AS score
  FROM spots JOIN level6 ON spots.gram = level6.gram GROUP BY id
), bins AS (
  SELECT greatest(-20000, least(20000, score)) AS bin, count(*) FILTER (WHERE said = 'allow') AS yes, count(*) FILTER (WHERE said <> 'allow') AS no
  FROM told JOIN scored ON told.id = scored.id WHERE said IS NOT NULL GROUP BY 1
), best AS (
  SELECT bin, sum(yes) OVER () AS yes_all, sum(no) OVER () AS no_all,
    sum(yes) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * sum(no) OVER ()
    + coalesce(sum(no) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(yes) OVER () AS good FROM bins
), lowest AS (
  SELECT coalesce((SELECT bin FROM best WHERE yes_all > 0 AND no_all > 0 ORDER BY good DESC, abs(bin), bin LIMIT 1), 0) AS least
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= least THEN 'allow' ELSE 'block' END) AS verdict
FROM told LEFT JOIN scored ON told.id = scored.id CROSS JOIN lowest
"""


@query("op11_urls", url_sql())
def op11_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


MANIFEST_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest_sql(heights: tuple[int, int] = (9, 4)) -> str:
    """The levels written out: up to 8**9 leaves per language, up to 8**4 languages."""

    def leaf(changed: str | None = None) -> str:
        values = [f"CAST({changed if c == 'text' and changed else c} AS VARCHAR)" for c in MANIFEST_COLUMNS]
        return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in values) + "))"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(4294967295, list_reduce(list_transform(range(0, length(CAST(doc_id AS VARCHAR)) + 1), lambda i:
      CASE WHEN i = 0 THEN 4294967295 ELSE ord(substr(CAST(doc_id AS VARCHAR), i, 1)) END), lambda crc, b:
      list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, bit: xor(c >> 1, (c & 1) * 3988292384))))"""
    out = f"""
WITH t0 AS (
  SELECT coalesce('1' || lang, '0') AS grp, doc_id, {leaf()} AS h, CASE WHEN ({crc}) % 3 = 0 THEN {leaf(low)} END AS forged FROM documents
), a0 AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM t0
)"""

    def level(name: str, n: int, keys: str) -> str:
        return f""", {name}r{n} AS (
  SELECT {keys}, pos // 8 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {name}{n} GROUP BY ALL
), {name}{n + 1} AS (
  SELECT {keys}, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 7) // 8 AS n FROM {name}r{n}
)"""

    out += "".join(level("a", n, "grp") for n in range(heights[0]))
    out += f""", b0 AS (
  SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, true AS one FROM a{heights[0]}
)"""
    out += "".join(level("b", n, "one") for n in range(heights[1]))
    out += """, d0 AS (
  SELECT grp, doc_id, h AS leaf, coalesce(forged, h) AS folded, pos, '' AS proof FROM a0
)"""

    def step(old: str, new: str, runs: str, on: str, rest: str) -> str:
        return f""", {new} AS (
  SELECT {rest}, d.pos // 8 AS pos, concat(proof, array_to_string(hs[:d.pos % 8], ''), array_to_string(hs[d.pos % 8 + 2:], '')) AS proof,
    CASE WHEN n = 1 THEN folded ELSE sha256(concat(array_to_string(hs[:d.pos % 8], ''), folded, array_to_string(hs[d.pos % 8 + 2:], ''))) END AS folded
  FROM {old} d JOIN {runs} r ON {on} AND r.run = d.pos // 8
)"""

    for n in range(heights[0]):
        out += step(f"d{n}", f"d{n + 1}", f"ar{n}", "d.grp = r.grp", "d.grp, doc_id, leaf")
    out += f""", e0 AS (
  SELECT d.doc_id, d.leaf, d.folded, d.proof, b0.pos, b0.h AS subroot FROM d{heights[0]} d JOIN b0 ON b0.grp = d.grp
)"""
    for n in range(heights[1]):
        out += step(f"e{n}", f"e{n + 1}", f"br{n}", "true", "doc_id, leaf, subroot")
    return out + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM e{heights[1]} CROSS JOIN (SELECT h FROM b{heights[1]})
"""


@query("op12_manifest", manifest_sql())
def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lowered = F.translate("text", urls.UPPER, urls.UPPER.lower())
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = merkle.rows_as_leaves(docs, MANIFEST_COLUMNS, "lang", "doc_id", {"text": lowered}, touched)
    path, root = F.col("path"), F.col("root")
    folded = merkle.fold(F.coalesce("extra.forged", "digest"), path)
    proof = merkle.digest(merkle.siblings_text(path)).alias("proof_sha256")
    out = merkle.manifest(leaves, ["by"]).select("extra.doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof, folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == root)


@query("op13_repair")
def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return repair.repair(repair.damaged(rows).withColumnRenamed("conv", "conv_id"), rows)
