"""Fuzzy search for a whole table of requests at once.

``graph.search`` puts the words of a few requests into the plan as literals and scores every node against each of them. Here requests are
rows: the plan has the same size for ten and for a million of them, and a word only meets texts that hold its rarest key.

What a key is follows from which matches can score 0.4 or better in a field (see ``SCALE``):

* names and tags may match by letters in order, so their keys are pairs of letters, one anywhere after the other. Letters fall into 75
  classes, so a text has at most 5,700 keys, however long it is;
* summaries match by a substring at least 5/9 as long as they are, or by a prefix: keys are pairs of adjacent letters;
* notes match by a prefix only: their key is the first letters.

A text that a word matches has all keys of the word, so looking under any one of them loses nothing; the least frequent is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemap.functions import dims
from lodemap.plans.cut import cut, first_rows, spread

K = "repo_id"
WORST = 0.4
#: What a match in a field counts, beside one in the name.
SCALE = {"name": 1.0, "tags": 0.4 / 0.3, "summary": 2.0, "notes": 4.0}
#: Letter classes: small Latin letters and digits have one each (code points modulo 75), others share.
CLASSES = 75
#: Parts that the rows under one key or one text are dealt into, one text's nodes by so many at least.
SALTS = 16
TEXT_ROWS = 400
PREFIX = 3
#: Letters of a word that are followed as columns; a lambda follows the rest, which costs some ten times as much a letter.
STEPS = 12
#: Requests of the same words that one part of them holds.
ASKERS = 1000


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _class(letter: Column) -> Column:
    return F.ascii(letter) % CLASSES


def _adjacent(text: Column) -> Column:
    """Keys of single letters and of every two that stand side by side."""
    letters = _letters(text)
    two = F.zip_with(letters, F.slice(letters, 2, F.greatest(F.size(letters), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.concat(letters, F.filter(two, lambda p: p.isNotNull())))


def _heads(text: Column) -> Column:
    return F.array_distinct(F.array(*[F.left(text, F.lit(n)) for n in range(1, PREFIX + 1)]))


def _keyed(df: DataFrame, text: str) -> DataFrame:
    """``df(field, ...)``, a row for each key of its column ``text``: ``key``, and in ``text``_held the classes of names and tags as bits.

    Names and tags: single classes, and every two of which one occurs somewhere after the other. Two classes meet as rows and the arrays
    are searched by plain functions, as lambdas take some twenty times as long. Steps are columns of their own, else each use works them
    out again; outer, else a filter for empty lists does.
    """
    ordered, value, held = F.col("field").isin("name", "tags"), F.col(text), f"{text}_held"
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    met = (
        df.filter(ordered).withColumn("_classes", F.transform(_letters(value), _class)).withColumn("_back", F.reverse("_classes"))
        .withColumn("_met", F.array_distinct("_classes")).withColumn("_after", F.concat(F.array(F.lit(-1)), "_met"))
        .withColumn(held, F.aggregate("_met", zero, lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", one, c % 64))))
        .select("*", F.explode_outer("_met").alias("_a")).withColumn("_first", F.array_position("_classes", F.col("_a")))
        .select("*", F.explode_outer("_after").alias("_b"))
        .filter((F.col("_b") < 0) | (F.col("_first") < F.size("_classes") + 1 - F.array_position("_back", F.col("_b"))))
    )
    number = F.when(F.col("_b") < 0, F.col("_a")).otherwise((F.col("_a") + 1) * CLASSES + F.col("_b"))
    keys = F.when(F.col("field") == "summary", _adjacent(value)).otherwise(_heads(value))
    return met.select(*df.columns, held, number.cast("string").alias("key")).unionByName(
        df.filter(~ordered).select(*df.columns, zero.alias(held), F.explode_outer(keys).alias("key")))


def _follow(df: DataFrame) -> DataFrame:
    """``df(value, token, _letters)`` with ``_walk``: where the last of the token's letters was met, each taken where it comes first, and
    how many stand right behind the one before; null where one is missing. Texts that hold the whole token are not walked."""
    text, size = F.col("value"), F.size("_letters")
    df = df.withColumn("_in", F.position("token", "value")).select(
        "*", F.when(F.col("_in") == 0, F.position(F.get("_letters", 0), text)).otherwise(0).alias("_at_0"), F.lit(0).alias("_beside_0"))
    for i in range(1, STEPS):
        before = F.col(f"_at_{i - 1}")
        df = df.withColumn(f"_at_{i}", F.when((before == 0) | (size <= i), before).otherwise(F.position(F.get("_letters", i), text, before + 1)))
        df = df.withColumn(f"_beside_{i}", F.col(f"_beside_{i - 1}") + F.when((size > i) & (F.col(f"_at_{i}") == before + 1) & (before > 0), 1).otherwise(0))
    at, beside = F.col(f"_at_{STEPS - 1}"), F.col(f"_beside_{STEPS - 1}")
    here = F.struct(at.alias("at"), beside.alias("adjacent"))

    def step(state: Column, letter: Column) -> Column:
        at = F.position(letter, text, state["at"] + 1)
        behind = ((at == state["at"] + 1) & (state["at"] > 0)).cast("int")
        return F.when(at > 0, F.struct(at.alias("at"), (state["adjacent"] + behind).alias("adjacent")))

    rest = F.aggregate(F.slice("_letters", STEPS + 1, F.greatest(size, F.lit(1))), here, step)
    return df.withColumn("_walk", F.when(at > 0, F.when(size <= STEPS, here).otherwise(rest)))


def field_score(text: Column, token: Column, walk: Column) -> Column:
    """0 for equal texts, 0.05 for a prefix, 0.12 and up inside, then 0.26 to 0.4 for letters in order; null where nothing matches."""
    n, m, at = F.length(text), F.length(token), F.position(token, text)
    inside = F.lit(0.12) + F.least(F.lit(0.2), (at - 1) / n * 0.2) + (1 - m / F.greatest(m, n)) * 0.18
    loose = F.when((m > 1) & walk.isNotNull(), F.greatest(F.lit(0.26), 0.40 - walk["adjacent"] / (m - 1) * 0.12 - m / n * 0.05))
    return F.when(text == token, 0.0).when(F.startswith(text, token), 0.05).when(at > 0, inside).otherwise(loose)


def _requests(requests: DataFrame) -> DataFrame:
    """(query_id, asked): each request's distinct words in order, with single spaces between them; those without a word are left out."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t]+"), lambda w: w != "")))
    return requests.select("query_id", F.array_join(words, " ").alias("asked")).filter("asked <> ''").distinct()


def _fields(nodes: DataFrame, limit: int) -> DataFrame:
    """(repo_id, id, node_ord, field, value), the first ``limit`` nodes for each text of a repository's field.

    A node beyond them has ``limit`` others before it wherever this text decides, so no list loses a row.
    """
    have = set(nodes.columns)
    summary = F.lower("summary") if "summary" in have else F.lit(None).cast("string")
    values = {
        "name": F.lower("name") if "name" in have else F.lit(None).cast("string"),
        "tags": F.lower(F.array_join("tags", " ")) if "tags" in have else F.lit(None).cast("string"),
        "summary": F.when(summary != dims.PENDING_SUMMARY.lower(), summary),
        "notes": F.lower("language_notes") if "language_notes" in have else F.lit(None).cast("string"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()]))
    order = "node_ord" if "node_ord" in have else "id"
    said = nodes.select(K, "id", F.col(order).alias("_o"), rows.alias("f")).select(K, "id", "_o", "f.field", "f.value").filter("value <> ''")
    return first_rows(said, [K, "field", "value"], ["_o", "id"], limit)


def match_texts(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(field, value, token, score): all matches of distinct ``tokens(token)`` in distinct ``texts(field, value)``, scaled, up to 0.4.

    Texts without letters and empty tables match nothing.
    """
    every = F.explode(F.array(*[F.lit(f) for f in SCALE]))
    # Keys cost time, not bytes, so words and texts are spread over as many tasks as a shuffle has, by a value that no grouping before
    # has dealt them by (else Spark drops the exchange).
    asked = _keyed(spread(tokens.select("token", every.alias("field")).withColumn("_deal", F.xxhash64("field", "token")), "_deal").drop("_deal"), "token")
    keyed = _keyed(spread(texts.select("field", "value", F.xxhash64("field", "value").alias("_deal")), "_deal").drop("_deal"), "value")
    counts = keyed.groupBy("field", "key").agg(F.count("*").alias("n"))  # combined in each task: few keys leave it
    # A key that no text has rules its word out.
    chosen = cut(asked.join(counts, ["field", "key"], "left").groupBy("field", "token", "token_held").agg(
        F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), F.col("key"))).alias("key"), F.count_if(F.col("n").isNull()).alias("absent"),
    ).filter("absent = 0").drop("absent"))
    # Names and tags have many keys, of which only those that a word looks under are moved: some 11,000 at most, whatever the input.
    ordered = F.col("field").isin("name", "tags")
    looked = F.broadcast(chosen.filter(ordered).select("field", "key").distinct().withColumn("_looked", F.lit(True)))
    postings = keyed.join(looked, ["field", "key"], "left").filter(F.col("_looked") | ~ordered).drop("_looked")
    # A frequent key's texts are dealt into parts, and each part meets all words that look there.
    dealt = postings.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
    looking = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_letters", _letters(F.col("token")))
    text, token, held = F.col("value"), F.col("token"), F.col("token_held")
    starts = F.startswith(text, token)
    possible = F.when(F.col("field") == "notes", starts).when(
        F.col("field") == "summary", starts | ((F.length(text) * 5 <= F.length(token) * 9) & F.contains(text, token))).otherwise(
        F.length(text) >= F.length(token))
    pairs = dealt.join(looking, ["field", "key", "part"]).filter((F.col("value_held").bitwiseAND(held) == held) & possible)
    scale = F.element_at(F.create_map(*[F.lit(x) for kv in SCALE.items() for x in kv]), F.col("field"))
    score = F.round(F.least(F.lit(1.0), field_score(text, token, F.col("_walk")) * scale), 6)
    # Exploded, else Spark works out the score a second time, in a filter before it.
    return _follow(pairs).select("field", "value", "token", F.explode_outer(F.array(score)).alias("score")).filter(F.col("score") <= WORST)


def search_requests(nodes: DataFrame, requests: DataFrame, limit: int = 50, types: list[str] | None = None) -> DataFrame:
    """Best nodes for each row of ``requests(query_id, text)``: (repo_id, query_id, id, score, hit_rank), as ``graph.search`` ranks them.

    Words are alternatives and the best field of the best word counts. Each distinct text is scored once, whatever number of nodes
    bears it, and requests of the same words are answered once. Null and empty texts match nothing, a request without a word has no rows, and of several rows with one
    ``query_id`` the words are taken together. Ties go by ``node_ord`` (``id`` without it), then ``id``, which a repository has once.
    """
    wanted = cut(_requests(requests))
    words = cut(wanted.select("asked").distinct()).select("asked", F.explode(F.split("asked", " ")).alias("token"))
    fields = cut(_fields(nodes if types is None else nodes.filter(F.col("type").isin(types)), limit))
    # A text that many repositories have is dealt out by repository.
    texts = cut(fields.groupBy("field", "value").agg(
        F.least(F.lit(SALTS), F.ceil(F.count("*") / TEXT_ROWS)).cast("int").alias("parts")))
    matches = match_texts(texts, words.select("token").distinct())
    best = matches.join(words, "token").groupBy("field", "value", "asked").agg(F.min("score").alias("score"))
    # It stands for its first node there: a node bears a text in each
    # field at most, so ``limit`` nodes come before all nodes of texts beyond the first ``limit`` times the fields.
    firsts = fields.groupBy(K, "field", "value").agg(F.min(F.struct("_o", "id")).alias("_first"))
    dealt = firsts.join(texts, ["field", "value"]).withColumn("part", F.pmod(F.xxhash64(K), F.col("parts")).cast("int"))
    looking = best.join(texts, ["field", "value"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ahead = first_rows(
        dealt.join(looking, ["field", "value", "part"]).select(K, "asked", "field", "value", "score", "_first"),
        [K, "asked"], ["score", "_first"], len(SCALE) * limit)
    ahead = ahead.select(F.col(K).alias("_k"), F.col("field").alias("_f"), F.col("value").alias("_v"), "asked", "score")
    here = F.col(K).eqNullSafe(F.col("_k")) & (F.col("field") == F.col("_f")) & (F.col("value") == F.col("_v"))
    hits = fields.join(ahead, here).groupBy(K, "asked", "id").agg(F.min("score").alias("score"), F.min("_o").alias("_o"))
    listed = first_rows(hits, [K, "asked"], ["score", "_o", "id"], limit)
    return _tell(listed, wanted, limit)


def _tell(listed: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """The lists ``listed(repo_id, asked, id, score, _o)`` to all who asked, ranked: ``wanted(query_id, asked)``.

    A list is one row until it is told. Most requests have one text, whose lists they take as they are; who has several gets the best
    of them ranked anew.
    """
    lists = listed.groupBy(K, "asked").agg(F.array_sort(F.collect_list(F.struct("score", "_o", "id"))).alias("_list"))
    who = cut(wanted.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("asked").alias("asked")))
    # Words that very many asked for are dealt into parts; few bytes make many rows here, so all tasks get some.
    one = who.filter("_n = 1").select("query_id", "asked")
    parts = one.groupBy("asked").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("_parts"))
    askers = spread(one.join(parts, "asked").select(
        "query_id", "asked", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int").alias("_part")), "asked", "_part")
    dealt = lists.join(parts, "asked").select(K, "asked", "_list", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    told = dealt.join(askers, ["asked", "_part"]).select(K, "query_id", F.posexplode("_list").alias("_at", "_hit")).select(
        K, "query_id", "_hit.id", "_hit.score", (F.col("_at") + 1).alias("hit_rank"))
    many = who.filter("_n > 1").select(F.col("query_id").alias("_q"))
    if many.isEmpty():
        return told
    several = wanted.join(many, F.col("query_id").eqNullSafe(F.col("_q")), "left_semi")
    again = lists.join(several, "asked").select(K, "query_id", F.explode("_list").alias("_hit")).groupBy(
        K, "query_id", F.col("_hit.id").alias("id")).agg(F.min("_hit.score").alias("score"), F.min("_hit._o").alias("_o"))
    w = Window.partitionBy(K, "query_id").orderBy("score", "_o", "id")
    ranked = again.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= limit).drop("_o")
    return told.unionByName(ranked)
