"""The queries opN_* and their SQL."""

from __future__ import annotations

from quillon.llm.bpe import encoded
from quillon.llm.common import table
from quillon.llm.exact_dedup import duplicate_groups
from quillon.llm.html_text import main_text
from quillon.llm.jaccard_join import near_duplicates
from quillon.llm.lm_score import lm_scores
from quillon.llm.media import media
from quillon.llm.mixing import mixture
from quillon.llm.quality import scored, train
from quillon.llm.suffix_dedup import without_repeats
from quillon.llm.token_store import stored_tokens

MIX = {
    "weights": {"domain": {"dom0": 4, "dom1": 3, "dom2": 2, "dom3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}},
    "percent": 60,
    "max_epochs": 2,
    "seed": 17,
}


def tokenizer_path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_text(name):
    with open(tokenizer_path(name), encoding="utf-8") as file:
        return file.read()


def op1_suffix_dedup(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"))


def op2_token_store(spark, sf_dir):
    return stored_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_html_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return duplicate_groups(table(spark, sf_dir, "documents"))


def op6_lm_score(spark, sf_dir):
    """The target is every document that labels call good."""
    return lm_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op7_bpe(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"), tokenizer_text("word_bpe_49k.json"))


def op8_mixing(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents"), **MIX)


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_webp(spark, sf_dir):
    return media(table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def mixing_ctes(docs: str, weights, percent: int, max_epochs: int, seed: int) -> str:
    """CTEs that end in dealt(doc_id, ..., copies), over the relation docs."""

    def weight(level):
        return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in weights.get(level, {}).items()) + " ELSE 1 END" if weights.get(level) else "1"

    def deal(name, up, parents, level):
        keys = ", ".join([*parents, level])
        by = f"PARTITION BY {', '.join(parents)}" if parents else ""
        budget = f"JOIN {up} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {up}"
        order = f"({by} ORDER BY cap / weight::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND"
        return f"""
{name}_n AS (SELECT {keys}, sum(supply)::BIGINT * {max_epochs} AS cap, ({weight(level)})::BIGINT AS weight FROM leaves GROUP BY {keys}),
{name}_a AS (SELECT {name}_n.*, budget,
  coalesce(sum(cap) OVER {order} 1 PRECEDING), 0) AS c_before,
  sum(weight) OVER ({by}) - coalesce(sum(weight) OVER {order} 1 PRECEDING), 0) AS w_rest FROM {name}_n {budget}),
{name}_b AS (SELECT *, min((cap * w_rest <= weight * (budget - c_before))::INT) OVER {order} CURRENT ROW) AS full_ FROM {name}_a),
{name}_c AS (SELECT *, sum(CASE WHEN full_ = 1 THEN cap ELSE 0 END) OVER ({by}) AS c_full, sum(CASE WHEN full_ = 0 THEN weight ELSE 0 END) OVER ({by}) AS w_open FROM {name}_b),
{name} AS (SELECT {keys}, (CASE WHEN full_ = 1 THEN cap ELSE (weight * (budget - c_full)) // w_open END)::BIGINT AS budget FROM {name}_c)"""

    return rf"""
docs_ AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
  regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS number FROM {docs}),
t AS (SELECT doc_id, CASE WHEN number = '' THEN 'none' ELSE 'dom' || (number::BIGINT % 4)::VARCHAR END AS domain, lang, source, n_tokens FROM docs_),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM t GROUP BY ALL),
total AS (SELECT floor(sum(supply) * {percent} / 100)::BIGINT AS budget FROM leaves),
{deal("d1", "total", [], "domain")},
{deal("d2", "d1", ["domain"], "lang")},
{deal("d3", "d2", ["domain", "lang"], "source")},
w AS (SELECT t.*, supply, budget, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS whole
      FROM t JOIN leaves USING (domain, lang, source) JOIN d3 USING (domain, lang, source)),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}/' || whole || '/' || doc_id), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM w),
dealt AS (SELECT doc_id, domain, lang, source, n_tokens, supply AS leaf_supply, budget AS leaf_budget,
      (whole + (upto <= budget - whole * supply)::INT)::BIGINT AS copies FROM o)"""


def oracle_sql():
    return {"op5_exact_dedup": OP5_SQL, "op8_mixing": f"WITH {mixing_ctes('documents', **MIX)} SELECT * FROM dealt"}
