"""Queries of sources, sinks, composition, errors and streams: what they read, they first write to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.media import MediaPlugin, get_mm_plugin, register_mm_plugin
from .functions.tokens import PATTERN, load_tokenizer
from .operators import sampling
from .operators.base import Context, Processor
from .operators.mapping import convert_to_messages
from .operators.pipeline import RowFunction, apply_all, list_processors, register_processor
from .plans.config import load_config
from .plans.prepare import prepare
from .plans.strategies import load_strategy, register_strategy
from .queries import FIRST_QA, LICENSED, PAIRS, TOKENS, chats, docs, instructions, query, spaced, sql_grams, sql_ids, sql_prompt, sql_scores, sql_with_eos, table
from .sources.load import load_dataset
from .sources.save import export, save_prepared, write_text
from .storage import Workspace
from .streaming import stream


def labelled(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """All parts with their labels."""
    out = None
    for k, df in parts.items():
        df = df.select(F.lit(k).alias(name), "*")
        out = df if out is None else out.unionByName(df)
    return out


def sql_labelled(parts: dict[str, str], name: str) -> str:
    return " union all ".join(f"select '{k}' as {name}, * from ({sql})" for k, sql in parts.items())


# sources:
_NATION = "select n_nationkey::bigint as id, n_name as name from nation"
FORMATS = ("parquet", "orc", "csv", "json", "jsonl")


@query(sql_labelled(dict.fromkeys(FORMATS, _NATION) | {"text": "select null::bigint as id, n_name as name from nation"}, "kind"))
def load_formats(spark, d):
    """A table written in each format, found by its files' names."""
    ws, nation = Workspace(spark), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    parts = {}
    for kind in FORMATS:
        folder = f"{ws.root}/{kind}"
        if kind == "json":  # one array
            rows = nation.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name")))).alias("v"))
            write_text(spark, f"{folder}/all.json", rows.first()["v"])
        elif kind == "csv":
            nation.write.csv(folder, header=True)
        else:
            nation.write.format("json" if kind == "jsonl" else kind).save(folder)
        parts[kind] = load_dataset(spark, {"path": folder, "format": kind}).select(F.col("id").cast("long").alias("id"), "name")
    nation.select("name").write.text(f"{ws.root}/lines")
    parts["text"] = load_dataset(spark, {"path": f"{ws.root}/lines"}).select(F.lit(None).cast("long").alias("id"), F.col("text").alias("name"))
    return labelled(parts, "kind")


@query("select s_suppkey as id, s_name as name, s_acctbal as balance, s_suppkey % 2 = 0 as even from supplier")
def load_data_files(spark, d):
    """Files named by a list and by a pattern, with a delimiter of their own."""
    ws, rows = Workspace(spark), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    for k, rest in (("even", 0), ("odd", 1)):
        rows.where(F.col("id") % 2 == rest).write.csv(f"{ws.root}/{k}", header=True, sep="|")
    how = {"path": "csv", "delimiter": "|", "schema": "id long, name string, balance double"}
    even = load_dataset(spark, how | {"data_files": [f"{ws.root}/even"]}).withColumn("even", F.lit(True))
    odd = load_dataset(spark, how | {"data_files": f"{ws.root}/od*"}).withColumn("even", F.lit(False))
    return even.union(odd)


_ORDERED = "(select o_orderkey, row_number() over (order by o_orderkey) - 1 as r, count(*) over () as n from orders)"


@query(sql_labelled({
    "whole": "select o_orderkey from orders", "test": "select c_custkey as o_orderkey from customer", "first": f"select o_orderkey from {_ORDERED} where r < 40",
    "middle": f"select o_orderkey from {_ORDERED} where r >= 100 and r < 250", "share": f"select o_orderkey from {_ORDERED} where r < round(n * 5 / 100)",
}, "split"))
def load_splits(spark, d):
    """Splits by folder, and slices of a split by counts and per cents."""
    ws = Workspace(spark)
    table(spark, d, "orders").select("o_orderkey").write.parquet(f"{ws.root}/data/train")
    table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey")).write.parquet(f"{ws.root}/data/test")
    of = lambda split: load_dataset(spark, {"path": f"{ws.root}/data", "split": split, "order_by": "o_orderkey"})
    return labelled({k: of(s) for k, s in (("whole", "train"), ("test", "test"), ("first", "train[:40]"), ("middle", "train[100:250]"), ("share", "train[:5%]"))}, "split")


@query(sql_labelled({
    "one": "select lang, doc_id from documents where lang = 'en'", "some": "select lang, doc_id from documents where lang in ('de', 'fr')",
    "all": "select lang, doc_id from documents", "missing": "select lang, doc_id from documents where lang = 'en'", "fallback": "select lang, doc_id from documents",
}, "subset"))
def load_subsets(spark, d):
    """One, several and all subsets; one that is missing is left out, and if all are, the path is read without."""
    ws, rows = Workspace(spark), table(spark, d, "documents").select("lang", "doc_id")
    for lang in [r["lang"] for r in rows.select("lang").distinct().collect()]:
        rows.where(F.col("lang") == lang).write.parquet(f"{ws.root}/all/{lang}")
    rows.write.parquet(f"{ws.root}/plain")
    of = lambda subset, path="all": load_dataset(spark, {"path": f"{ws.root}/{path}", "subset": subset}).select("lang", "doc_id")
    return labelled({"one": of("en"), "some": of(["de", "fr"]), "all": of("_ALL"), "missing": of(["en", "none"]), "fallback": of("none", "plain")}, "subset")


@query("select n_nationkey, 3 + n_nationkey as width, 2 + n_nationkey % 4 as height, 'L' as mode from nation")
def load_images(spark, d):
    """A folder of image files: their sizes are known when they are loaded."""
    ws = Workspace(spark)
    for r in table(spark, d, "nation").select("n_nationkey").collect():  # 25 files
        k = r[0]
        write_text(spark, f"{ws.root}/n{k}.pgm", f"P5 {3 + k} {2 + k % 4} 255\n" + "a" * ((3 + k) * (2 + k % 4)))
    out = load_dataset(spark, {"path": ws.root, "format": "imagefolder"})
    return out.select(F.regexp_extract("image.path", r"n(\d+)\.pgm$", 1).cast("int").alias("n_nationkey"), *(f"image.{c}" for c in ("width", "height", "mode")))


# sinks and whole runs:
_RUN = {"tokenizer_config": "native", "sequence_len": 64, "val_set_size": 0.1, "order_by": "doc_id"}
_IDS_64 = f"array_to_string({sql_with_eos('a', 64)}, ' ')"
_SPLIT_BY = "case when row_number() over (order by md5('42|' || doc_id), doc_id) <= ceil(0.1 * count(*) over ()) then 'eval' else 'train' end"


def _prepared(spark: SparkSession, d: str, ws: Workspace):
    cfg = {**_RUN, "dataset_prepared_path": f"{ws.root}/prepared", "datasets": [
        {"path": f"{d}/documents.parquet", "type": "completion", "keep_columns": ["doc_id"], "processors": [{"type": "filter", "min_length": 200}]},
    ]}
    return cfg, prepare(spark, load_config(cfg, ["datasets.0.processors.0.min_length=400"]))


@query(f"select split, doc_id, {_IDS_64} as input_ids from (select doc_id, {_SPLIT_BY} as split, {sql_ids('text')} as a from documents where length(text) >= 400 or text = '')")
def prepared_run(spark, d):
    """A whole run by its configuration, saved and read again: the paths are of the split, tokenizer and length."""
    ws = Workspace(spark)
    cfg, done = _prepared(spark, d, ws)
    save_prepared(cfg, done.train, done.test)
    back = {k: load_dataset(spark, {"path": f"{ws.root}/prepared/{k}_native_64"}) for k in ("train", "eval")}
    return labelled(back, "split").select("split", "doc_id", spaced("input_ids").alias("input_ids"))


@query("""select 'rows' as name, count(*)::varchar as value from documents union all select 'characters', sum(length(text))::varchar from documents union all select 'license', 'mit'
union all select 'size_categories', case when count(*) < 1000 then 'n<1K' when count(*) < 10000 then '1K<n<10K' when count(*) < 100000 then '10K<n<100K' else '100K<n<1M' end from documents""")
def export_card(spark, d):
    """What an upload would send: the data, statistics, and a card, read back from their files."""
    ws, cfg = Workspace(spark), {"export": {"enabled": True, "organization": "org", "dataset_name": "set-1", "license": "mit"}}
    rows = table(spark, d, "documents")
    stats = rows.agg(F.sum(F.length("text")).alias("characters")).first().asDict()
    path = export(rows, ws.root, cfg, stats)
    saved = spark.read.text(f"{path}/stats.json", wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("name", "value"))
    line = spark.read.text(f"{path}/README.md")
    card = line.where("value like 'license: %'").select(F.lit("license").alias("name"), F.substring_index("value", ": ", -1).alias("value"))
    size = line.where(F.col("value").rlike("^- '?n|^- [0-9]+K")).select(F.lit("size_categories").alias("name"), F.regexp_replace("value", "^- |'", "").alias("value"))
    return saved.union(card).union(size)


# composition:
@query("select doc_id, length(text) as chars, lang = 'en' as english from documents where length(text) >= 300")
def custom_processors(spark, d):
    """A function of rows, one of tables, and a class, all registered by name, in one chain."""

    class Long(Processor):
        def transform(self, df):
            return df.where(F.length("text") >= self.config["least"])

    register_processor("example_long", Long)
    register_processor("example_rows", lambda config, context: RowFunction(lambda r: {"doc_id": r["doc_id"], "chars": len(r["text"]), "english": r["lang"] == "en"}, "doc_id long, chars long, english boolean", config, context))
    register_processor("example_table", lambda config, context: lambda df: df.select("doc_id", "text", "lang"))
    assert {"example_long", "example_rows", "example_table"} <= set(list_processors())
    return docs(spark, d, {"type": "example_table"}, {"type": "example_long", "least": 300}, {"type": "example_rows"})


_TWICE = "regexp_replace(regexp_replace(text, '[0-9]', '#', 'g'), '#+', '0', 'g')"


@query(f"select doc_id, {_TWICE} as text from documents where length(text) >= 100 and not regexp_matches({_TWICE}, '[*$%&]') or text = ''")
def named_processors(spark, d):
    """Named steps that a pipeline, and a later step, refer to."""
    rules = lambda p, to: {"type": "regex_transform", "transformations": [{"field": "text", "pattern": p, "replacement": to}]}
    steps = [
        {"type": "filter", "name": "long", "min_length": 100},
        {"name": "digits", **rules("[0-9]", "#")},
        {"type": "pipeline", "processors": [{"name": "runs", **rules("#+", "0")}, {"type": "regex_filter", "name": "symbols", "filter_patterns": [{"field": "text", "pattern": "[*$%&]"}]}]},
        "runs",
        {"reference": "symbols"},
    ]
    return docs(spark, d, *steps).select("doc_id", "text")


CONDITIONS = {
    "field_exists": ({"type": "field_exists", "fields": ["lang", "source"]}, "true"),
    "field_not_exists": ({"type": "field_not_exists", "fields": ["lang"]}, "false"),
    "field_equals": ({"type": "field_equals", "values": {"lang": "en"}}, "lang = 'en'"),
    "field_not_equals": ({"type": "field_not_equals", "values": {"lang": "en"}}, "lang <> 'en'"),
    "custom": ({"type": "custom", "sql": "n_chars % 2 = 0"}, "n_chars % 2 = 0"),
}


@query(sql_labelled({k: f"select doc_id from documents where not ({c}) or length(text) >= 800 or text = ''" for k, (_, c) in CONDITIONS.items()}, "condition"))
def conditions(spark, d):
    """A filter under each kind of condition: rows that don't meet it stay."""
    return labelled({k: docs(spark, d, {"type": "filter", "min_length": 800, "condition": c}).select("doc_id") for k, (c, _) in CONDITIONS.items()}, "condition")


@query("select doc_id, case when lang = 'en' then regexp_replace(text, '[0-9]+', '', 'g') else text end as text from documents")
def conditional_transform(spark, d):
    rule = {"type": "regex_transform", "transformations": [{"field": "text", "pattern": "[0-9]+"}], "condition": {"type": "field_equals", "field": "lang", "value": "en"}}
    return docs(spark, d, rule).select("doc_id", "text")


_FAILS = "case when n_chars % 7 = 0 then 'ValueError' when n_chars % 11 = 0 then 'KeyError' end"


def _failing(row: dict) -> dict:
    if row["n_chars"] % 7 == 0:
        raise ValueError("seven")
    if row["n_chars"] % 11 == 0:
        raise KeyError("eleven")
    return row


@query(f"select 'good' as kind, doc_id, null::varchar as error_type, 1::bigint as n from documents where {_FAILS} is null union all select 'errors', null, {_FAILS}, count(*) from documents where {_FAILS} is not null group by 3")
def error_modes(spark, d):
    """Rows that fail are left out, and counted by the kind of error; the function runs once."""
    out, step = None, RowFunction(_failing, context=Context(error_mode="raise_after_k", max_errors=1 << 30))
    good = step(table(spark, d, "documents").select("doc_id", "n_chars"))
    out = good.select(F.lit("good").alias("kind"), "doc_id", F.lit(None).cast("string").alias("error_type"), F.lit(1).cast("long").alias("n"))
    return out.union(step.errors.select(F.lit("errors"), F.lit(None).cast("long"), "error_type", "count"))


# mappings and text:
@query("select conv_id, coalesce(arg_min(text, turn) filter (role = 'system'), arg_min(role, turn)) as lead, max(turn) as turns, max(turn) as last_turn, arg_min(text, turn) as opening from conversations group by 1")
def advanced_mapping_more(spark, d):
    """The first of several fields, one value for several targets, columns removed before a rule."""
    c = table(spark, d, "conversations")
    first = lambda test, v: F.min_by(F.when(test, F.col(v)), F.when(test, F.col("turn")))
    info = F.struct(first(F.col("role") == "system", "text").alias("system"), first(F.lit(True), "role").alias("role"), F.max("turn").alias("most"))
    rows = c.groupBy("conv_id").agg(info.alias("info"), first(F.lit(True), "text").alias("opening"), F.count("*").alias("junk"))
    rules = [{"source": "info", "extract_first_of": ["system", "role"], "target": "lead", "remove_before": "junk"}, {"source": "info.most", "targets": ["turns", "last_turn"], "remove_after": ["info"]}]
    return apply_all(rows, [{"type": "advanced_mapping", "mappings": rules, "required_fields": ["lead"]}]).select("conv_id", "lead", "turns", "last_turn", "opening")


@query(f"select conv_id, q as content_1, a as content_2 from {FIRST_QA} where q <> '' and a <> ''")
def detect_format(spark, d):
    """Questions and answers are told by their columns, and messages stay as they are."""
    c = table(spark, d, "conversations")
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    out = convert_to_messages(c.groupBy("conv_id").agg(first("user").alias("instruction"), first("assistant").alias("output")))
    out = convert_to_messages(out)
    return out.select("metadata.conv_id", F.col("messages")[0]["content"].alias("content_1"), F.col("messages")[1]["content"].alias("content_2"))


@query("select doc_id, regexp_replace(regexp_replace(text, '(?i)THE ', 'X '), '[a-z]+\\.', '.', 'g') as text from documents")
def regex_transform_count(spark, d):
    """At most one replacement, flags of a rule, and a rule after it on the same field."""
    rules = [{"field": "text", "pattern": "THE ", "replacement": "X ", "flags": ["IGNORECASE"], "count": 1}, {"field": "text", "pattern": r"[a-z]+\.", "replacement": "."}]
    return docs(spark, d, {"type": "regex_transform", "transformations": rules}).select("doc_id", "text")


FLAGGED = {"dotall": (r"The.+\n.+licensed", ["DOTALL", "I"], r"(?is)The.+\n.+licensed"), "multiline": (r"^\d+", ["M"], r"(?m)^\d+"), "verbose": ("[0-9] # a digit\n [0-9]", ["VERBOSE"], "[0-9][0-9]"), "ascii": (r"\w@\w", ["ASCII"], r"[A-Za-z0-9_]@[A-Za-z0-9_]")}


@query(sql_labelled({k: f"select doc_id from documents where regexp_matches(text, '{sql}')" for k, (_, _, sql) in FLAGGED.items()}, "flag"))
def regex_flags(spark, d):
    rule = lambda p, f: {"type": "regex_filter", "default_flags": [], "filter_patterns": [{"field": "text", "pattern": p, "flags": f, "action": "keep_only"}]}
    return labelled({k: docs(spark, d, rule(p, f)).select("doc_id") for k, (p, f, _) in FLAGGED.items()}, "flag")


_JOINED = "concat_ws(' ', nullif(text, ''), nullif(source, ''))"


@query(f"select doc_id, len(regexp_extract_all({_JOINED}, '{PATTERN}')) as tokens from documents where len(regexp_extract_all({_JOINED}, '{PATTERN}')) between 100 and 900")
def joined_text_filter(spark, d):
    """Tokens of several fields, joined."""
    out = docs(spark, d, {"type": "hf_filter", "min_tokens": 100, "max_tokens": 900, "text_fields": ["text", "none", "source"]})
    both = F.concat_ws(" ", F.when(F.col("text") != "", F.col("text")), F.when(F.col("source") != "", F.col("source")))
    return out.select("doc_id", TOKENS.count(both).cast("long").alias("tokens"))


_N = f"len(regexp_extract_all(text, '{PATTERN}'))"


@query(f"""select count(*) as total, count(*) filter (text <> '' and {_N} between 100 and 900) as passed, count(*) filter (text = '') as no_text_content, count(*) filter (text <> '' and {_N} < 100) as token_count_too_low,
count(*) filter ({_N} > 900) as token_count_too_high, 0::bigint as corrupted_image, 0::bigint as image_size_invalid, 0::bigint as multiple_failures from documents""")
def token_filter_stats(spark, d):
    """The counts that the filter itself makes while it runs."""
    context = Context(tokenizer=TOKENS)
    apply_all(table(spark, d, "documents"), [{"type": "hf_filter", "min_tokens": 100, "max_tokens": 900, "text_fields": ["text"], "collect_stats": True}], context).count()
    return _counted(spark, context)


def _counted(spark: SparkSession, context: Context) -> DataFrame:
    (numbers,) = context.stats().values()
    kinds = ", ".join(f"`{k}` {'double' if isinstance(v, float) else 'long'}" for k, v in numbers.items())
    return spark.createDataFrame([tuple(numbers.values())], kinds)


@query("""select count(*) as total, count(*) filter (not s and not l) as kept, count(*) filter (s or l) as filtered, count(*) filter (s) as symbols, count(*) filter (l) as licensed,
round(count(*) filter (s or l) / count(*), 9) as filter_rate, round(1 - count(*) filter (s or l) / count(*), 9) as keep_rate from (select regexp_matches(text, '[*$%&#]{3}') as s, regexp_matches(text, '(?i)licensed under') as l from documents)""")
def regex_filter_stats(spark, d):
    context = Context()
    patterns = [{"field": "text", "pattern": r"[*$%&#]{3}", "description": "symbols"}, {"field": "text", "description": "licensed", **LICENSED}]
    apply_all(table(spark, d, "documents"), [{"type": "regex_filter", "filter_patterns": patterns, "collect_stats": True}], context).count()
    rates = lambda c: F.round(F.col(c), 9).alias(c)
    return _counted(spark, context).select("total", "kept", "filtered", F.col("symbols: filtered").alias("symbols"), F.col("licensed: filtered").alias("licensed"), rates("filter_rate"), rates("keep_rate"))


# strategies:
@query(f"select conv_id, turn, array_to_string(case when len(a) > 0 then a[1:48] || case when len(a) < 48 then [e] else [] end else a end, ' ') as input_ids from (select conv_id, turn, {sql_ids(sql_prompt('alpaca'))} as a, ('0x' || substr(md5('<|im_end|>'), 1, 7))::bigint % 1000000 as e from {PAIRS})")
def tokenizer_specials(spark, d):
    """A tokenizer by its configuration, with an EOS that is named by its text."""
    spec = load_tokenizer({"tokenizer_config": "native", "special_tokens": {"eos_token": "<|im_end|>"}})
    out = load_strategy("alpaca", spec, {"sequence_len": 48, "train_on_inputs": True}, {"keep_columns": ["conv_id", "turn"]})(instructions(spark, d))
    return out.select("conv_id", "turn", spaced("input_ids").alias("input_ids"))


@query("select doc_id, lang || ': ' || text as text from documents")
def custom_strategy(spark, d):
    register_strategy("example_labelled", lambda spec, cfg, dataset: lambda df: df.select("doc_id", F.concat("lang", F.lit(": "), "text").alias("text")))
    return load_strategy("example_labelled", TOKENS, {})(table(spark, d, "documents"))


class _Numbered(MediaPlugin):
    """An image token with the number of its message."""

    def process_messages(self, messages, images=None):
        return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.replace(m["content"], F.lit("<image>"), F.concat(F.lit("<image-"), i.cast("string"), F.lit(">"))).alias("content")))


@query("select conv_id, string_agg(case when role = 'user' then '<image-' || r || '>' else '' end || text, '|' order by turn) as text from (select *, row_number() over (partition by conv_id order by turn) - 1 as r from conversations) group by 1")
def custom_mm_plugin(spark, d):
    try:
        plugin = get_mm_plugin("example_numbered")
    except ValueError:
        register_mm_plugin("example_numbered", _Numbered)
        plugin = get_mm_plugin("example_numbered")
    asked = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", F.concat(F.lit("<image>"), m["content"])).otherwise(m["content"]).alias("content")))
    c = chats(spark, d).select("conv_id", asked.alias("messages"))
    return c.select("conv_id", F.array_join(F.transform(plugin.process_messages(F.col("messages")), lambda m: m["content"]), "|").alias("text"))


@query("select doc_id, text, lang from documents")
def filter_only_strategy(spark, d):
    return load_strategy("filter_only", TOKENS, {})(table(spark, d, "documents").select("doc_id", "text", "lang"))


# duplicates:
_LANDS = "(select n_name as a, r_name as b from (select distinct n_name from nation), region)"
_HELD = f"""select n_nationkey, n_name from nation where n_name not in (select a from {sql_scores(_LANDS)} where score >= 33)
and n_name not in (select x.id from {sql_grams('nation', 'n_name', 'n_name', 1)} x join {sql_grams('region', 'r_name', 'r_name', 1)} y on x.gram = y.gram)"""


@query(_HELD)
def dedup_external(spark, d):
    """Names held against a file, read by the source layer, by ratio and by grams; one that can't be read is left out."""
    ws = Workspace(spark)
    table(spark, d, "region").select("r_name").write.csv(f"{ws.root}/theirs", header=True, sep=";")
    theirs = [{"path": "csv", "data_files": [f"{ws.root}/theirs"], "column": "r_name", "delimiter": ";"}, {"path": f"{ws.root}/none"}]
    spec = {"type": "deduplicator", "method": "combined", "column": "n_name", "similarity_threshold": 33.0, "ngram_size": 1, "external_datasets": theirs, "internal": False}
    return apply_all(table(spark, d, "nation").select("n_nationkey", "n_name"), [spec], Context(tokenizer=TOKENS, order_by="n_nationkey"))


@query("""select 'rows' as step, count(*) as n from documents union all select 'internal', count(*) from (select text, row_number() over (partition by text order by doc_id) as r from documents where length(text) % 5 <> 0) where r > 1
union all select 'external', count(*) from (select text, min(doc_id) as m from documents where length(text) % 5 <> 0 group by 1) where text in (select text from documents where length(text) % 2 = 0)
union all select 'kept', (select count(distinct text) from documents where length(text) % 5 <> 0) - (select count(distinct text) from documents where length(text) % 5 <> 0 and length(text) % 2 = 0) + (select count(*) from documents where length(text) % 5 = 0)""")
def dedup_report(spark, d):
    """What each part of a deduplication removed; nulls (here, every text whose length is a multiple of five) are kept."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.length("text") % 5 != 0, F.col("text")).alias("text"))
    theirs = table(spark, d, "documents").where(F.length("text") % 2 == 0).select("text")
    context = Context(order_by="doc_id")
    spec = {"type": "deduplicator", "method": "fuzzy", "similarity_threshold": 100.0, "external_datasets": [theirs], "report": True}
    apply_all(rows, [spec], context)
    (report,) = context.reports.values()
    return spark.createDataFrame([(k, int(v)) for k, v in report.items()], "step string, n long")


# sampling:
@query("""select n_nationkey, count(*) as draws from (select ('0x' || substr(md5('0|' || k), 1, 15))::bigint % (select count(*) from nation) as r from range(10) t(k))
join (select n_nationkey, row_number() over (order by n_nationkey) - 1 as r from nation) using (r) group by 1""")
def sample_dataset(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("_row_id"))
    return sampling.sample_dataset(nation, 10).groupBy("n_nationkey").agg(F.count("*").alias("draws"))


@query("select r_regionkey, r_name, (select (count(*) // 6) * 3 from orders) as steps from region")
def sampler_equal_and_steps(spark, d):
    """As many rows as there are: unchanged; and a run's number of steps."""
    region = table(spark, d, "region")
    same = apply_all(region, [{"type": "random_sampler", "sample_size": region.count()}], Context(order_by="r_regionkey"))
    return same.withColumn("steps", F.lit(sampling.step_count(table(spark, d, "orders").count(), 2, 3, 3)).cast("long"))


# streams:
@query("select doc_id, regexp_replace(text, '[0-9]+', '0', 'g') as text from documents where length(text) between 200 and 5000 or text = ''")
def stream_chain(spark, d):
    """Row-local processors on a stream of files, run until what is there is done."""
    ws, rows = Workspace(spark), table(spark, d, "documents")
    live = stream.read_stream(spark, "parquet", f"{d}/documents.parquet", rows.schema)
    steps = [{"type": "filter", "min_length": 200, "max_length": 5000}, {"type": "regex_transform", "transformations": [{"field": "text", "pattern": "[0-9]+", "replacement": "0"}]}]
    out = stream.apply_stream(live, steps).select("doc_id", "text")
    stream.write_stream(out, f"{ws.root}/out", f"{ws.root}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{ws.root}/out")


@query("""select start::varchar as start, event_type, n from (select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2)
where start + interval '1 hour' <= (select max(ts) - interval '2 hours' from events)""")
def stream_windows(spark, d):
    """Counts by window, emitted when the watermark has passed it."""
    ws, rows = Workspace(spark), table(spark, d, "events")
    live = stream.read_stream(spark, "parquet", f"{d}/events.parquet", rows.schema)
    out = stream.windowed_counts(live, key="event_type", width="1 hour", delay="2 hours").select(F.col("window.start").cast("timestamp_ntz").cast("string").alias("start"), "event_type", "n")
    stream.write_stream(out, f"{ws.root}/out", f"{ws.root}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{ws.root}/out")


@query("select event_type, user_id from events group by all")
def stream_repeats(spark, d):
    """Rows with a key that was seen within the watermark's delay are dropped."""
    ws, rows = Workspace(spark), table(spark, d, "events")
    live = stream.read_stream(spark, "parquet", f"{d}/events.parquet", rows.schema).withColumn("text", F.concat_ws("|", "event_type", "user_id"))
    out = stream.drop_repeats(live, delay="10000 days").select("event_type", "user_id")
    stream.write_stream(out, f"{ws.root}/out", f"{ws.root}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{ws.root}/out")
