"""Secret scans: candidate strings, and a random forest that removes false positives. DataFrame functions only.

A candidate is a run of 16 or more letters, digits and + / _ - with a digit in it, or the value assigned after a cue word
(password=..., "token": "..."): six or more characters of any kind up to the closing quote or, without quotes, up to white
space, the next field (;name= or &name=) or a closing tag. Its features are length, shares and
transitions of character classes, the share covered by dictionary words, the kind of path it stands in and the words beside
it. The forest is fitted by MLlib on labelled findings and then written out as a SQL expression, so each document is scanned,
scored and, in the pipeline, redacted in its own row: no shuffle, no join, and nothing gathered but the bounded sample. The query
stores the findings of its one pass over the texts, learns from them and scores them.

No labels of secrets are given, so the query labels findings itself (``LABEL``): formats that issuers publish and
assigned values are secrets; numbers, words, digests and placeholders are not; the rest is not learnt from but scored.

Nulls and empty texts have no candidate. Rows are taken one by one: repeated rows give repeated findings, a missing doc_id or
path is null. An empty table gives an empty result; without findings of both classes the share of secrets decides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.llm.common import stored

MASK = "[SECRET]"
#: Findings used for fitting, at most.
MAX_FINDINGS = 20_000
TREES, DEPTH = 25, 6
#: Characters looked at on either side of a candidate.
REACH = 48

# Words that stand beside secrets, words that stand in strings that are none, paths of samples.
_CUES = "password|passwd|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|auth|bearer|credential|login"
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
_ASSIGN = rf"(?<=(?:{_CUES})(?:[_-][A-Za-z0-9_-]{{0,16}})?[\"'\]]{{0,2}}\s{{0,3}}(?:=>|:=|[=:])\s{{0,3}}"
#: The short look back comes first, so that most positions are settled by one character.
_ASSIGNED = (rf"(?i:(?<=\")(?<=[=:>]\s{{0,3}}\"){_ASSIGN}\")(?=[^\"\r\n]{{6,}}\")[^\"\r\n]+"
             rf"|(?<=')(?<=[=:>]\s{{0,3}}'){_ASSIGN}')(?=[^'\r\n]{{6,}}')[^'\r\n]+"
             rf"|(?<=[=:>\s\"'])(?![\s\"'`=:>])(?<=[=:>]\s{{0,3}}[\"']?){_ASSIGN}[\"']?)[^\s\"'`]{{6,}}?(?=[,;.:)\]}}]{{0,3}}(?:[\s\"'`]|</|\z)|[;&,][a-z_][a-z0-9_.-]{{0,40}}=))")
CANDIDATE = f"{_ASSIGNED}|{_RUN}"
_DIGESTS = "sha1|sha256|sha512|md5|commit|checksum|digest|hash|revision|etag|uuid|guid"
_DICTIONARY = ("example|sample|test|dummy|demo|fake|mock|todo|change|default|placeholder|insert|your|here|user|name|file|image|page|index|"
               "http|www|com|html|version|build|release|module|package|class|function|config|data|value|string|number|public|static|the|and|"
               "for|with|from|this|that|not|are|was|have|which|their|there|tion|ing")
_SAMPLE_PATH = "test|example|sample|fixture|mock|docs?/|readme"

#: name: SQL over x.token, x.before, x.after and the column path.
FEATURES = {
    "length": "cast(length(x.token) as double)",
    "digit_share": "regexp_count(x.token, '[0-9]') / length(x.token)",
    "upper_share": "regexp_count(x.token, '[A-Z]') / length(x.token)",
    "lower_share": "regexp_count(x.token, '[a-z]') / length(x.token)",
    "hex_share": "regexp_count(x.token, '[0-9a-f]') / length(x.token)",
    "transitions": "(regexp_count(x.token, '[0-9](?=[A-Za-z])') + regexp_count(x.token, '[A-Za-z](?=[0-9])') + "
                   "regexp_count(x.token, '[a-z](?=[A-Z])')) / length(x.token)",
    "same_next": r"regexp_count(x.token, '(.)(?=\\1)') / length(x.token)",
    "next_letter": "regexp_count(x.token, 'ab|bc|cd|de|ef|12|23|34|45|56|67|78|89|qw|we|er|rt|ty') / length(x.token)",
    "vowel_share": "regexp_count(lower(x.token), '[aeiou]') / length(x.token)",
    "distinct_share": "size(array_distinct(split(x.token, ''))) / least(length(x.token), 64)",
    "dictionary": f"1.0D - length(regexp_replace(lower(x.token), '{_DICTIONARY}', '')) / length(x.token)",
    "joins": "regexp_count(x.token, '[_/+-]') / length(x.token)",
    "sample_path": f"case when lower(path) rlike '{_SAMPLE_PATH}' then 1.0D else 0.0D end",
    "in_path": "case when right(x.before, 1) in ('.', '@', ':', '~', '?', '&') then 1.0D else 0.0D end",
    "assigned": r"case when x.before rlike '[=:]\\s*[\"\']?$' then 1.0D else 0.0D end",
    "cue_before": f"case when lower(x.before) rlike '({_CUES})[^a-z]*$' then 1.0D else 0.0D end",
    "cue_near": f"cast(regexp_count(lower(x.before), '{_CUES}') as double)",
    "digest_before": f"case when lower(x.before) rlike '({_DIGESTS})[^a-z]*$' then 1.0D else 0.0D end",
    "words_before": r"cast(regexp_count(x.before, '\\b[a-zA-Z]+\\b') as double)",
    "closed": r"case when x.after rlike '^[\"\'\\s.,;)]|^$' then 1.0D else 0.0D end",
}

# Published formats of keys.
_FORMATS = ("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^xox[abprs]-[0-9A-Za-z-]{10,}$|^sk_(live|test)_[0-9A-Za-z]{16,}$|"
            "^AIza[0-9A-Za-z_-]{35}$|^glpat-[0-9A-Za-z_-]{20}$")
#: 1 a secret, 0 none, null not known; over the features f and the candidate x.
LABEL = (f"case when x.token rlike '{_FORMATS}' and f.dictionary < 0.3 then 1 "
         "when f.digit_share = 1 or f.dictionary >= 0.4 or f.digest_before = 1 or f.same_next > 0.4 then 0 "
         "when f.cue_before = 1 and f.assigned = 1 and f.distinct_share > 0.2 then 1 "
         "when f.assigned = 0 and f.digit_share < 0.1 then 0 end")


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """``docs`` with ``_gaps``, the text between candidates, and ``_found``, an array of structs:

    token, before, after, at (code points before it) and f (the features).
    """
    gaps = F.split(F.coalesce("text", F.lit("")), CANDIDATE, -1)
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CANDIDATE), F.lit(0))
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    split = docs.withColumns({"_path": F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string"), "_has": has})
    split = split.withColumns({"_gaps": F.when(F.col("_has"), gaps), "_tokens": F.when(F.col("_has"), tokens)})
    ends = ("aggregate(sequence(1, size(_tokens)), cast(array(0) as array<bigint>), (s, i) -> concat(s, array("
            "element_at(s, i) + length(element_at(_gaps, i)) + length(element_at(_tokens, i)))))")
    split = split.withColumn("_ends", F.when(F.col("_has"), F.expr(ends)))
    raw = (f"transform(_tokens, (t, i) -> struct(t as token, right(concat(if(i > 0, right(_tokens[i - 1], {REACH}), ''), _gaps[i]), {REACH}) as before, left(_gaps[i + 1], {REACH}) as after,"
           " _ends[i] + length(_gaps[i]) as at))")
    split = split.withColumn("_raw", F.when(F.col("_has"), F.expr(raw)))
    parts = ", ".join(f"cast({sql.replace('lower(path)', 'lower(coalesce(_path, ' + chr(39) * 2 + '))')} as double) as {name}" for name, sql in FEATURES.items())
    return (split.withColumn("_found", F.expr(f"transform(_raw, x -> struct(x.token, x.before, x.after, x.at, struct({parts}) as f))"))
            .drop("_path", "_tokens", "_ends", "_raw"))


def label_findings(docs: DataFrame, max_rows: int = MAX_FINDINGS) -> DataFrame:
    """At most ``max_rows`` findings with a known label, in hash order, each distinct string once: features and y."""
    return _labelled(candidates(docs).where("_has"), max_rows)


def _labelled(found: DataFrame, max_rows: int = MAX_FINDINGS) -> DataFrame:
    # Not explode: Spark would put the size of its array, and so the search, into a filter and search each text again.
    rows = (found.select(F.explode_outer("_found").alias("x")).select("x", F.col("x.f").alias("f"))
            .withColumn("y", F.expr(LABEL)).where("y is not null"))
    once = rows.groupBy(F.xxhash64("x.token").alias("h"), "y").agg(F.min_by("f", F.struct("x.before", "x.after")).alias("f"))
    return once.orderBy("h", "y").limit(max_rows).select("f.*", "y")


def _tree_sql(lines: list[str], names: list[str]) -> str:
    """SQL of one tree from its printed form: indented If, Else and Predict lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return str(float(line.split(":")[1])) + "D"
    m = re.match(r"If \(feature (\d+) <= ([-+.0-9Ee]+)\)", line)
    yes = _tree_sql(lines, names)
    lines.pop(0)  # its Else
    no = _tree_sql(lines, names)
    return f"case when x.f.{names[int(m[1])]} <= {float(m[2])!r}D then {yes} else {no} end"


def fit(findings: DataFrame) -> str:
    """SQL for the share of trees that call candidate x a secret. ``findings`` has the features and y."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(FEATURES)
    rows = findings.persist()
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return "1.0D" if n.get(1) else "0.0D"
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(rows.select(*names, F.col("y").cast("double").alias("y")))
    model = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt").fit(vectors)
    rows.unpersist()
    trees: list[list[str]] = []
    for line in model.toDebugString.splitlines()[1:]:
        if line.strip().startswith("Tree"):
            trees.append([])
        elif line.strip():
            trees[-1].append(line)
    return f"({' + '.join(_tree_sql(t, names) for t in trees)}) / {len(trees)}"


def _scored(found: DataFrame, forest: str) -> DataFrame:
    """_hits: the candidates with score (the forest's) added."""
    return found.withColumn("_hits", F.expr(f"transform(_found, x -> struct(x.token, x.at, x.before, {forest} as score))"))


def scan(docs: DataFrame, forest: str, threshold: float = 0.5, path: str | None = "source") -> DataFrame:
    """(doc_id, start, end, kind, token_sha256, score): findings at the threshold or above, end exclusive, in code points."""
    return _reported(candidates(docs, path).where("_has"), forest, threshold)


def fit_and_scan(docs: DataFrame) -> DataFrame:
    """``scan`` of ``docs`` by a forest fitted on their own findings: texts are searched once, their findings stored."""
    found = stored(candidates(docs).where("_has").select("doc_id", "_found"))
    return _reported(found, fit(_labelled(found)))


def _reported(found: DataFrame, forest: str, threshold: float = 0.5) -> DataFrame:
    hits = _scored(found, forest).select("doc_id", F.explode_outer("_hits").alias("h")).where(F.col("h.score") >= threshold)
    kind = (F.when(F.col("h.token").rlike(_FORMATS), "key")
            .otherwise(F.coalesce(F.nullif(F.regexp_extract(F.lower("h.before"), f"({_CUES})[^a-z]*$", 1), F.lit("")), F.lit("other"))))
    return hits.select("doc_id", F.col("h.at").alias("start"), (F.col("h.at") + F.length("h.token")).alias("end"), kind.alias("kind"),
                       F.sha2("h.token", 256).alias("token_sha256"), F.col("h.score").alias("score"))


def redact(docs: DataFrame, forest: str, threshold: float = 0.5, path: str | None = "source") -> DataFrame:
    """Pipeline stage: each secret is replaced by ``MASK`` and n_chars, where there is one, follows; all rows stay."""
    rows = _scored(candidates(docs, path), forest)
    joined = (f"concat(concat_ws('', transform(_hits, (h, i) -> concat(_gaps[i], if(h.score >= {threshold}, '{MASK}', h.token)))),"
              " element_at(_gaps, -1))")
    rows = rows.withColumn("_clean", F.when(F.col("_has"), F.expr(joined)).otherwise(F.col("text")))
    columns = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        changed = F.col("_has") & (F.col("_clean") != F.col("text"))
        columns["n_chars"] = F.when(changed, F.length("_clean").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return rows.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])
