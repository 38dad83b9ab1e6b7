"""Answers from block documents, checked against what the documents hold.

Documents are those of ``extract.block_documents`` with a ``doc_id``.  Retrieval ranks candidates by five keys; answers that need no generator are put together
from blocks; generated ones are validated and replaced where they say what no document does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import contains_any, excerpt, first_by_key, installs_subject, normalized, profile_terms, sentences, urls
from docloom.operators.answers import NO_ANSWER, supported
from docloom.operators.extract import FENCED_ANYWHERE
from docloom.session import kept

#: Phrases of what a question to blocks wants, in English and Spanish.
WANTS = {
    "commands": ["what commands", "which commands", "commands do i need", "command do i need", "show commands", "installation commands", "install commands", "comandos", "comando", "ejecutar", "ejecuto", "run ", "execute "],
    "yaml": ["yaml", ".yaml", ".yml", "manifest", "values file", "values.yaml", "show me the yaml", "show yaml", "muéstrame el yaml"],
    "output": ["output", "salida", "expected output", "what should i see", "qué debo ver", "show output", "logs", "log output"],
    "script": ["script", ".sh", "entry point", "main script", "sqlplus", "jar"],
    "steps": ["how", "cómo", "steps", "pasos", "install", "installation", "create", "set up", "setup"],
    "prereq": ["prerequisite", "pre-requisite", "requirements", "tools", "iam", "license", "access key", "access keys", "prerequisito"],
    "troubleshooting": ["error", "issue", "problem", "fails", "timeout", "troubleshoot", "debug"],
}
#: Bonuses for kinds of documents, for topics and for places of the subject; documents retrieved and kept; what answers show.
KIND_BONUS = {"commands": (("shell_command",), 4), "yaml": (("yaml",), 5), "script": (("script", "sql"), 5), "output": (("output",), 5)}
SECTION_BONUS, TOPIC_BONUS, SUBJECT_BONUS = 2, 4, {"heading": 10, "in_heading": 8, "title": 3, "content": 4}
TOP_RETRIEVED, TOP_KEPT, MOST_BLOCKS, BLOCK_TYPES = 18, 10, 8, ("shell_command", "yaml", "script", "output", "json", "sql")
MOST = {"commands": 12, "yamls": 2, "fallback_commands": 5, "excerpt": 500}
COMMAND_WORDS = r"^(kubectl |helm |terraform |eksctl |aws |docker |export |java -jar |curl |\./|source \./|SQL>@|lsnrctl )"
OUTPUT_WORDS = r"(NAME\s+NAMESPACE\s+REVISION|NAME\s+READY\s+STATUS|CLUSTER\s+NODEGROUP\s+STATUS)"


def intents(queries: DataFrame, topics: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_id, wants_..., installs, topic): what each question wants of blocks; it wants to install by commands if it names both; its topic is the first of ``topics`` it names."""
    q = normalized("text")
    topic = F.lit(None).cast("string")
    for name, needles in reversed(list((topics or {}).items())):
        topic = F.when(contains_any(q, needles), name).otherwise(topic)
    installing = contains_any(q, ["command", "comando"]) & contains_any(q, ["install", "instalar"])
    return queries.select("query_id", *(contains_any(q, words).alias(f"wants_{name}") for name, words in WANTS.items()), installing.alias("installs"), topic.alias("topic"))


def place_of(subject: Column, heading: Column, title: Column, content: Column) -> Column:
    """Where a subject stands, at best: heading, in_heading, title or content; null if nowhere."""
    s, h = normalized(subject), normalized(heading)
    found = F.when(h == s, "heading").when(h.contains(s), "in_heading").when(normalized(title).contains(s), "title").when(normalized(content).contains(s), "content")
    return F.when(s != "", found)


def retrieve(found: DataFrame, asked: DataFrame, documents: DataFrame, top: int = TOP_KEPT) -> DataFrame:
    """(query_id, doc_id, rank): of the documents found (query_id, doc_id, score) those with the subject at the best place there is, by five keys: the subject's place, what is
    wanted, shared terms, and the score.  ``asked`` are (query_id, text, subject, wants_..., topic)."""
    rows = found.join(asked, "query_id").join(documents, "doc_id")
    at = place_of(F.col("subject"), F.col("heading"), F.col("doc_title"), F.col("content"))
    bonus = F.lit(0)
    for want, (kinds, points) in KIND_BONUS.items():
        bonus = bonus + F.when(F.col(f"wants_{want}") & F.col("block_type").isin(*kinds), points).otherwise(0)
    bonus = bonus + F.when(F.col("wants_steps") & (F.col("doc_type") == "section"), SECTION_BONUS).otherwise(0)
    bonus = bonus + F.when(F.array_contains("topic_tags", F.col("topic")), TOPIC_BONUS).otherwise(0)
    named = F.coalesce(F.create_map(*(F.lit(x) for pair in SUBJECT_BONUS.items() for x in pair))[at], F.lit(0))
    shared = F.size(F.array_intersect(profile_terms("text", "blocks"), profile_terms("content", "blocks")))
    tiers = {"heading": 1, "in_heading": 2, "title": 3, "content": 4}
    tier = F.coalesce(F.create_map(*(F.lit(x) for pair in tiers.items() for x in pair))[at], F.lit(5))
    scored = rows.select("query_id", "doc_id", "score", named.alias("named"), F.coalesce(bonus, F.lit(0)).alias("bonus"), shared.alias("shared"), tier.alias("tier"))
    best = scored.withColumn("best", F.min("tier").over(Window.partitionBy("query_id"))).where("tier = best")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("named"), F.desc("bonus"), F.desc("shared"), F.desc("score"), "doc_id"))
    return best.select("query_id", "doc_id", rank.alias("rank")).where(F.col("rank") <= top)


def allowed_blocks(chosen: DataFrame, documents: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """(query_id, block_type, blocks): the blocks an answer may show, by kind, in the order of the documents, each once, the first ``most``."""
    rows = chosen.join(documents.where(F.col("doc_type") == "block").where(F.col("block_type").isin(*BLOCK_TYPES)).select("doc_id", "block_type", "body"), "doc_id").where("trim(body) <> ''")
    lists = rows.groupBy("query_id", "block_type").agg(F.array_sort(F.collect_list(F.struct("rank", F.trim("body").alias("body")))).alias("b"))
    return lists.select("query_id", "block_type", F.slice(first_by_key(F.transform("b", lambda x: x["body"])), 1, most).alias("blocks"))


def yaml_lines(text: Column) -> Column:
    """Lines of YAML that are neither blank nor comments, without blanks at their ends."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.filter(lines, lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))


def supported_yaml(block: Column, known: Column) -> Column:
    """Whether the lines of a YAML block are, in their order, among those of a known one."""
    from docloom.operators.answers import in_order

    own = yaml_lines(block)
    return (F.size(own) > 0) & F.exists(known, lambda k: in_order(own, yaml_lines(k)))


def supported_output(block: Column, known: Column) -> Column:
    """Whether an output, normalised, is part of a known one."""
    return F.exists(known, lambda k: normalized(k).contains(normalized(block)))


def answer_blocks(answers: DataFrame) -> DataFrame:
    """(query_id, lang, block): code blocks of answers (query_id, answer); one without a language is plain."""
    pairs = F.arrays_zip(*(F.regexp_extract_all("answer", F.lit(FENCED_ANYWHERE), F.lit(i)).alias(name) for i, name in ((1, "lang"), (2, "block"))))
    rows = answers.select("query_id", F.explode(pairs).alias("p"))
    return rows.select("query_id", F.when(F.col("p.lang") == "", "plain").otherwise(F.lower("p.lang")).alias("lang"), F.regexp_replace("p.block", r"^\s+|\s+\z", "").alias("block"))


def problems(answers: DataFrame, chosen: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, problem, what): what answers (query_id, answer) say that their documents don't: URLs, commands, YAML and outputs.

    Commands in blocks without a language are checked too.
    """
    pages = chosen.join(documents.select("doc_id", F.col("page_url").alias("url")), "doc_id").select("query_id", "url").where("url is not null").distinct()
    foreign = answers.select("query_id", F.explode(urls("answer")).alias("url")).join(pages, ["query_id", "url"], "left_anti").select("query_id", F.lit("url").alias("problem"), F.col("url").alias("what"))
    allowed = allowed_blocks(chosen, documents, 1 << 20)
    empty = F.array().cast("array<string>")
    known = allowed.groupBy("query_id").agg(*(F.coalesce(F.flatten(F.collect_list(F.when(F.col("block_type").isin(*kinds), F.col("blocks")))), empty).alias(name) for name, kinds in (("known_commands", ("shell_command", "script")), ("known_yaml", ("yaml",)), ("known_output", ("output",)))))
    blocks = answer_blocks(answers).join(known, "query_id", "left")
    for name in ("known_commands", "known_yaml", "known_output"):
        blocks = blocks.withColumn(name, F.coalesce(name, empty))
    lines = F.filter(F.split("block", "\n"), lambda x: F.regexp_replace(x, r"^\s*\$?\s*", "").rlike(COMMAND_WORDS))
    said = blocks.where(F.col("lang").isin("bash", "sh", "shell", "plain")).select("query_id", "known_commands", F.explode(lines).alias("what"))
    known_lines = F.flatten(F.transform("known_commands", lambda b: F.split(b, "\n")))
    commands = said.where(~supported(F.col("what"), known_lines)).select("query_id", F.lit("command").alias("problem"), "what")
    yaml = blocks.where(F.col("lang").isin("yaml", "yml") & ~supported_yaml(F.col("block"), F.col("known_yaml"))).select("query_id", F.lit("yaml").alias("problem"), F.col("block").alias("what"))
    output = blocks.where(F.col("lang").isin("text", "plain") & F.col("block").rlike(OUTPUT_WORDS) & ~supported_output(F.col("block"), F.col("known_output"))).select("query_id", F.lit("output").alias("problem"), F.col("block").alias("what"))
    return foreign.unionByName(commands).unionByName(yaml).unionByName(output).distinct()


def excerpts(chosen: DataFrame, asked: DataFrame, documents: DataFrame, first: int = 3, profile: str = "blocks") -> DataFrame:
    """(query_id, place, excerpt): of each of the first documents the earliest sentence with most of the question's terms, else its beginning (whole sentences, for chunks)."""
    terms = asked.select("query_id", F.array_distinct(profile_terms("text", profile)).alias("asked"))
    rows = chosen.where(F.col("rank") <= first).join(documents.select("doc_id", "content"), "doc_id").join(terms, "query_id").where("trim(content) <> ''")
    hits = F.transform(sentences("content"), lambda s, i: F.struct(F.size(F.array_intersect("asked", profile_terms(s, profile))).alias("hits"), (-i).alias("at"), s.alias("sentence")))
    best = F.array_max(F.filter(hits, lambda x: x["hits"] > 0))["sentence"]
    beginning = excerpt("content", 450) if profile == "chunks" else F.substring(F.trim("content"), 1, MOST["excerpt"])
    return rows.select("query_id", F.col("rank").alias("place"), F.coalesce(best, beginning).alias("excerpt"))


def gathered(chosen: DataFrame, asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, commands, yamls, outputs, scripts): the bodies of each kind in the chosen documents, each once; of questions for commands to install only those that do, and name the subject."""
    kinds = {"commands": ("shell_command", "script"), "yamls": ("yaml",), "outputs": ("output",), "scripts": ("script", "sql")}
    rows = chosen.join(documents.where("doc_type = 'block'").select("doc_id", "block_type", "body"), "doc_id")
    lists = rows.groupBy("query_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("block_type").isin(*k), F.struct("rank", "body")))).alias(name) for name, k in kinds.items()))
    lists = lists.join(asked.select("query_id", "subject", F.col("installs").alias("only")), "query_id")
    each = {name: F.transform(name, lambda x: x["body"]) for name in kinds}
    each["commands"] = F.filter(F.flatten(F.transform(each["commands"], lambda b: F.split(b, "\n"))), lambda c: ~F.col("only") | installs_subject(c, F.col("subject")))
    return lists.select("query_id", *(first_by_key(x).alias(name) for name, x in each.items()))


def _fenced(lang: str, items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"```{lang}\n"), x, F.lit("\n```"))), "\n")


def deterministic(chosen: DataFrame, asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, answer): answers that need no generator: of questions that want just commands, YAML, outputs or scripts, or commands with YAML."""
    held = gathered(chosen, asked, documents).join(asked, "query_id")
    wants = {name: F.col(f"wants_{name}") for name in ("commands", "yaml", "output", "script")}
    alone = lambda name: wants[name] & ~F.expr(" or ".join(f"wants_{other}" for other in wants if other != name))
    some = lambda name: F.size(name) > 0
    commands = F.concat(F.lit("```bash\n"), F.array_join("commands", "\n"), F.lit("\n```"))
    both = F.concat_ws("\n", F.when(some("commands"), F.concat(F.lit("```bash\n"), F.array_join(F.slice("commands", 1, MOST["commands"]), "\n"), F.lit("\n```"))), F.when(some("yamls"), _fenced("yaml", F.slice("yamls", 1, MOST["yamls"]))))
    answer = F.when(alone("commands") & some("commands"), commands).when(alone("yaml") & some("yamls"), _fenced("yaml", F.slice("yamls", 1, 3))).when(alone("output") & some("outputs"), _fenced("text", F.slice("outputs", 1, 3))).when(alone("script") & some("scripts"), _fenced("bash", F.slice("scripts", 1, 3)))
    answer = F.coalesce(answer, F.when(wants["commands"] & wants["yaml"] & (some("commands") | some("yamls")), both))
    return held.select("query_id", answer.alias("answer")).where("answer is not null")


def fallback(chosen: DataFrame, asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, answer): what the documents do say: excerpts, commands, a YAML block and an output; a fixed text without documents."""
    parts = excerpts(chosen, asked, documents).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "excerpt"))).alias("e"))
    parts = parts.select("query_id", F.array_join(F.transform("e", lambda x: x["excerpt"]), "\n").alias("said"))
    plain = asked.withColumn("installs", F.lit(False))
    held = asked.select("query_id").join(parts, "query_id", "left").join(gathered(chosen, plain, documents), "query_id", "left")
    command = F.when(F.size("commands") > 0, F.concat(F.lit("```bash\n"), F.array_join(F.slice("commands", 1, MOST["fallback_commands"]), "\n"), F.lit("\n```")))
    answer = F.concat_ws("\n\n", "said", command, F.when(F.size("yamls") > 0, _fenced("yaml", F.slice("yamls", 1, 1))), F.when(F.size("outputs") > 0, _fenced("text", F.slice("outputs", 1, 1))))
    return held.select("query_id", F.when(answer == "", NO_ANSWER).otherwise(answer).alias("answer"))


def answer_flow(chosen: DataFrame, asked: DataFrame, documents: DataFrame, generator=None) -> DataFrame:
    """(query_id, kind, answer): a deterministic answer, else a generated one if nothing is wrong with it, else the fallback."""
    from docloom.operators.services import generated

    sure = kept(deterministic(chosen, asked, documents))
    safe = fallback(chosen, asked, documents)
    out = asked.select("query_id").join(sure.withColumnRenamed("answer", "sure"), "query_id", "left").join(safe.withColumnRenamed("answer", "safe"), "query_id", "left")
    if generator is None:
        said = F.lit(None).cast("string")
    else:
        rest = asked.join(sure, "query_id", "left_anti")
        context = chosen.join(documents.select("doc_id", "content"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("content", 1, 2600).alias("content")))).alias("c"))
        prompts = rest.join(context, "query_id").select("query_id", F.concat(F.array_join(F.transform("c", lambda x: x["content"]), "\n\n"), F.lit("\n\nQuestion: "), F.coalesce("text", F.lit(""))).alias("prompt"))
        given = kept(generated(prompts, "query_id", "prompt", generator).select("query_id", F.col("generated").alias("answer")))
        good = given.join(problems(given, chosen, documents).select("query_id").distinct(), "query_id", "left_anti").where("trim(answer) <> ''")
        out = out.join(good.withColumnRenamed("answer", "said"), "query_id", "left")
        said = F.col("said")
    kind = F.when(F.col("sure").isNotNull(), "deterministic").when(said.isNotNull(), "generated").otherwise("fallback")
    return out.select("query_id", kind.alias("kind"), F.coalesce("sure", said, "safe").alias("answer"))
