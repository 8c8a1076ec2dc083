"""Registered corpus queries: each applies one operator with production parameters to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascreen.llm import bpe, language_model, lexical, licenses, manifest, merkle, neighbours, packing, secrets, simhash, surrogates, toxicity, urls
from terrascreen.llm.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

END_ID = 2
SEQUENCE_TOKENS = 1024


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces and their places; the ids are those of byte_bpe_50k.json, read from the rank file of the same vocabulary."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(table(spark, folder, "documents"), ranks, END_ID, SEQUENCE_TOKENS)


@query("op8_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of the ids and of the decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at three bits."""
    marked = written(simhash.fingerprints(table(spark, folder, "documents")), "simhash-bits")
    return simhash.near_duplicates(marked).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query("op7_toxicity")
def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents; the field has learnt from labelled documents that are not held out."""
    docs = table(spark, folder, "documents")
    field = toxicity.fit(docs, table(spark, folder, "labels"), training=~held_out())
    scored = toxicity.score(docs, field)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")


@query("op1_secret_scans")
def secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """All findings per document, and the digest of those that stand alone."""
    found = secrets.scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < secrets.BASE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:secrets.BASE])],
                        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query("op2_document_fingerprints")
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    found = merkle.compared(table(spark, folder, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next", "first_edit")


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    def canon(text: str) -> str:
        sql = f"regexp_replace(lower({text}), '(^|\\n)[^a-z0-9\\n]*(?:copyright|\\(c\\)|©)[^\\n]*', '\\1', 'g')"
        sql = f"regexp_replace({sql}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        for old, new in licenses.SPELLINGS.items():
            sql = f"replace({sql}, {quote(old)}, {quote(new)})"
        return f"[trim(x) for x in string_split({sql}, chr(10)) if trim(x) <> '']"

    rows = ", ".join(f"({i}, {quote(name)}, {quote(text)})" for i, (name, text) in enumerate(licenses.KNOWN))
    return f"""with known as (select sha256(array_to_string({canon('body')}, ' ')) as digest, arg_min(name, i) as license
      from (values {rows}) as t(i, name, body) group by 1),
    cut as (select row_number() over () as n, doc_id, {canon("coalesce(text, '')")} as lines from documents),
    noticed as (select n, string_agg(license, ',' order by license) as notices from (
      select distinct c.n, k.license from (select n, unnest(lines) as line from cut) as c join known as k on sha256(c.line) = k.digest) as d group by n)
    select doc_id, sha256(array_to_string(lines, ' ')) as digest, license, coalesce(notices, '') as notices
    from cut left join known on sha256(array_to_string(lines, ' ')) = known.digest left join noticed on cut.n = noticed.n"""


@query("op6_license_scans", _license_sql())
def license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of all documents against the known texts."""
    return licenses.scan(table(spark, folder, "documents"), licenses.known_licenses(spark))


SITES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def _url_sql() -> str:
    rest = "case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
    upper, lower = urls.UPPER, urls.LOWER
    fits = " ".join(
        f"when (host = '{host}' or host like '%.{host}') and starts_with(path, '/{path}') then " + "'{" + str(i) + "}'"
        for i, (host, path) in enumerate((p.partition("/")[0], p.partition("/")[2]) for p, _ in sorted(SITES, key=lambda s: -len(s[0]))))
    ordered = sorted(SITES, key=lambda s: -len(s[0]))
    rule = "case " + fits.format(*[p for p, _ in ordered]) + " end"
    verdict = "case " + fits.format(*[v for _, v in ordered]) + " end"
    words = "|".join("[-_.+/]".join(w.split()) for w in urls.WORDS)
    return f"""with a as (select page_id, {rest} as rest from pages),
    b as (select page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a)
    select page_id, host, path, {rule} as rule,
      coalesce({verdict}, case when regexp_matches(translate(rest, '{upper}', '{lower}'), '(^|[^a-z0-9])({words})([^a-z0-9]|$)') then 'block' else 'allow' end) as verdict from b"""


@query("op3_url_filters", _url_sql())
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """All pages by the site rules, and by word rules where no site rule fits."""
    rules = [urls.site_rule(*s) for s in SITES] + [urls.word_rule(w) for w in urls.WORDS]
    judged = urls.judge(table(spark, folder, "pages"), urls.rule_table(spark, rules))
    return judged.select("page_id", "host", "path", F.when(F.col("matched_rank") > 0, F.col("matched")).alias("rule"), "verdict")


@query("op5_approximate_neighbours")
def approximate_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op9_pii_surrogates")
def pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with surrogates in place of personal data; production takes the key from its own secret store."""
    swapped = surrogates.replaced(table(spark, folder, "documents"), b"terrascreen surrogate key")
    return swapped.select("doc_id", F.size("entities").cast("bigint").alias("n_entities"),
                          F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",").alias("entities"), "text")


def _lexical_sql() -> str:
    words = lambda text: f"regexp_extract_all(translate({text}, '{urls.UPPER}', '{urls.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""with given as (select row_number() over () as nr, doc_id, {words("text")} as terms from documents where text is not null),
      sizes as (select nr, doc_id, len(terms)::bigint as n, terms from given where len(terms) > 0),
      totals as (select count(*) as docs, sum(n)::bigint as total from sizes),
      counted as (select nr, t, count(*) as tf from (select nr, unnest(terms) as t from sizes) group by nr, t),
      weights as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from counted, totals group by t, docs),
      asked as (select nr, item_id, t, count(*) as times from (select row_number() over () as nr, item_id, unnest({words("text")}) as t from benchmark) group by all),
      scored as (select a.nr, a.item_id, s.nr as doc_nr, s.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint as score
        from asked as a join counted as c on a.t = c.t join weights as w on w.t = a.t join sizes as s on s.nr = c.nr, totals group by all),
      ranked as (select item_id, row_number() over (partition by nr order by score desc, doc_id nulls last) as rank, doc_id, score from scored where score > 0)
    select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10"""


@query("op11_lexical_search", _lexical_sql())
def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def aside():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


@query("op12_recurrent_scores")
def recurrent_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all documents; the network has learnt from those that are not held out. A missing id is learnt from."""
    docs = table(spark, folder, "documents")
    model = language_model.fit(docs, ~F.coalesce(aside(), F.lit(False)))
    scored = language_model.score(docs, model)
    return scored.select("doc_id", F.coalesce(aside(), F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score")


LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _manifest_sql() -> str:
    def leaf(*values: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(({v})::varchar) || ':' || ({v})::varchar, '-')" for v in values) + ")"

    def tree(name: str, leaves: str, key: str) -> str:
        """All levels of the trees over ``leaves(key, spot, h, n)``."""
        return f"""{name} as (select {key}, 0 as lv, spot, h, n from {leaves} union all
          select {key}, lv + 1, spot // 2, sha256(string_agg(h, '' order by spot)), (any_value(n) + 1) // 2 from {name} where n > 1 group by {key}, lv, spot // 2)"""

    def runs(levels: str, leaves: str, key: str, part: int) -> str:
        return f"""select l.row_nr, {part} as part, u.lv, coalesce(s.h, '') as h, (l.spot >> u.lv) & 1 as odd
          from {leaves} as l join (select distinct {key}, lv from {levels} where n > 1) as u on l.{key} is not distinct from u.{key}
          left join {levels} as s on s.{key} is not distinct from l.{key} and s.lv = u.lv and s.spot = xor(l.spot >> u.lv, 1)"""

    plain, tampered = leaf(*LEAF_COLUMNS), leaf("doc_id", "source", "lang", "n_chars + 1", "text")
    return f"""with recursive crc as (select i, i as v, 0 as step from range(256) as t(i) union all
        select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, step + 1 from crc where step < 8),
      crc_table as (select list(v order by i) as entries from crc where step = 8),
      given as (select *, row_number() over () as row_nr, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [ord(c)::bigint for c in string_split(doc_id::varchar, '')]),
        lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) as sum32 from documents, crc_table),
      leaves as (select row_nr, doc_id, lang, {plain} as h, case when sum32 % 7 = 0 then {tampered} else {plain} end as changed,
        row_number() over (partition by lang order by doc_id nulls first, {plain}) - 1 as spot, count(*) over (partition by lang) as n from given),
      {tree("up", "leaves", "lang")},
      subroots as (select lang, h, row_number() over (order by lang nulls first) - 1 as spot, count(*) over () as n, 0 as one from up where n = 1),
      {tree("top", "subroots", "one")},
      rooted as (select l.row_nr, l.doc_id, l.h as leaf, l.changed, s.h as subroot, s.spot, 0 as one from leaves as l join subroots as s on l.lang is not distinct from s.lang),
      steps as ({runs("up", "leaves", "lang", 0)} union all {runs("top", "rooted", "one", 1)}),
      proofs as (select row_nr, string_agg(h, '' order by part, lv) as siblings,
        list({{'b': case when odd = 1 then h else '' end, 'a': case when odd = 1 then '' else h end}} order by part, lv) as steps from steps group by row_nr),
      folded as (select r.*, coalesce(siblings, '') as siblings, list_reduce(list_prepend({{'b': changed, 'a': ''}}, coalesce(steps, [])),
        lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b as folded_root from rooted as r left join proofs as p on r.row_nr = p.row_nr)
    select doc_id, leaf, subroot, root, sha256(siblings) as proof_sha256, folded_root, folded_root = root as verified
    from folded, (select h as root from top where n = 1) as t"""


@query("op13_dataset_manifest", _manifest_sql())
def dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf and proof, and whether a copy in which some rows are tampered with still leads to the root."""
    docs = table(spark, folder, "documents")
    columns = [F.col(c) for c in LEAF_COLUMNS]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = manifest.leaf_digest(*[c + 1 if n == "n_chars" else c for n, c in zip(LEAF_COLUMNS, columns)])
    docs = docs.withColumn("changed", F.when(touched, changed))
    signed = manifest.manifest(docs, LEAF_COLUMNS, "lang", "doc_id", keep=("doc_id", "changed"))
    siblings = F.array_join(F.transform("proof", lambda run: F.concat(run["before"], run["after"])), "")
    signed = signed.withColumn("folded_root", manifest.folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return signed.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
