"""The ordered fold of post events with all they write, over pieces of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curalens.sources.landing import land

POST_STATES = ["planned", "publishing", "published", "failed", "skipped", "deleted"]
PLANNED, PUBLISHING, PUBLISHED, FAILED, SKIPPED, CLOSED = range(6)
#: Actions that change the state come first; the others only write fields.
MOVING = ["claim", "finish", "fail", "skip", "abandon", "retry", "requeue"]
ACTIONS = [*MOVING, "reschedule", "caption", "image_order", "note", "share", "unshare", "permalink"]
PIECE_ROWS = 1024


def step(action: str, state: int, tries: int, limit: int) -> tuple[int, int]:
    """What a moving action does to (state, attempts). Guards decide whether it applies."""
    if action == "claim" and state == PLANNED and tries < limit:
        return PUBLISHING, tries + 1
    if action == "finish":
        return PUBLISHED, tries
    if action == "fail":
        return (FAILED if tries >= limit else PLANNED), tries
    if action == "abandon" or (action == "skip" and state in (PLANNED, FAILED)):
        return SKIPPED, tries
    if action == "retry" and state in (FAILED, SKIPPED):
        return PLANNED, 0
    if action == "requeue" and state == PUBLISHED:
        return PLANNED, 0
    return state, tries


def transitions(limit: int) -> list[list[int]]:
    """For each moving action, the code each code becomes. A code is state * (limit + 1) + attempts."""
    width = limit + 1
    return [[s * width + t for c in range(len(POST_STATES) * width) for s, t in [step(a, c // width, c % width, limit)]] for a in MOVING]


def _then(first: Column, second: Column) -> Column:
    """Two maps over codes, one after the other."""
    return F.transform(first, lambda code: F.element_at(second, code + 1))


def pieces_of(events: DataFrame, piece_rows: int) -> DataFrame:
    """Events in the order (post, at, seq), landed in ranges; a piece is a run of at most ``piece_rows`` rows of a range.

    Ranges split wherever there are many rows, so one post, one day or one second with a third of
    all events lies in many ranges, and its pieces follow each other by (part, piece).
    """
    number = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action")) - 1
    optional = {"value": "string", "other": "string", "value_at": "timestamp", "by_hand": "boolean"}
    columns = ["post_id", "at", "seq", number.cast("int").alias("act"),
               *[F.col(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]]
    ordered = (events.filter(F.col("action").isin(ACTIONS) & F.col("post_id").isNotNull()).select(*columns)
               .repartitionByRange("post_id", "at", "seq").sortWithinPartitions("post_id", "at", "seq")
               .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    return land(ordered, "post-events").withColumn("piece", F.floor(F.col("row") / piece_rows))


def _start_codes(rows: DataFrame, first: DataFrame, limit: int) -> DataFrame:
    """(post_id, part, piece, code): the code each piece of a post in several pieces begins with.

    Each piece but the last is folded to a map from every code to its result. Maps compose: pieces to a map per part, and the
    parts of a post, from the code its row has, to the code each part begins with; then back inside the parts.
    """
    tables = F.array(*[F.array(*[F.lit(c) for c in m]) for m in transitions(limit)])
    same = F.array(*[F.lit(c) for c in range(len(POST_STATES) * (limit + 1))])
    at = F.struct("part", "piece")
    several = (rows.groupBy("post_id").agg(F.min(at).alias("_first"), F.max(at).alias("_last")).filter(F.col("_first") < F.col("_last"))
               .select("post_id", "_last"))
    moves = F.when((F.col("act") < len(MOVING)) & (at < F.col("_last")), F.struct("row", "act"))
    maps = land(rows.join(several, "post_id").groupBy("post_id", "part", "piece").agg(F.array_sort(F.collect_list(moves)).alias("run"))
                .select("post_id", "part", "piece", F.aggregate("run", same, lambda acc, e: _then(acc, F.element_at(tables, e["act"] + 1))).alias("step")),
                "post-maps")
    parts = maps.groupBy("post_id", "part").agg(F.array_sort(F.collect_list(F.struct("piece", "step"))).alias("pieces"))

    def scan(steps: Column, start: Column, name: str) -> Column:
        """Each step's name with the code it begins with."""
        none = F.array().cast(f"array<struct<{name}:bigint,code:int>>")
        done = F.aggregate(steps, F.struct(start.alias("code"), none.alias("out")), lambda acc, s: F.struct(
            F.element_at(s["step"], acc["code"] + 1).alias("code"),
            F.concat(acc["out"], F.array(F.struct(s[name].cast("bigint").alias(name), acc["code"].alias("code")))).alias("out")))
        return done["out"]

    whole = parts.select("post_id", "part", F.aggregate("pieces", same, lambda acc, p: _then(acc, p["step"])).alias("step"))
    per_post = whole.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("part", "step"))).alias("parts")).join(first, "post_id")
    of_parts = per_post.select("post_id", F.inline(scan(F.col("parts"), F.col("first"), "part"))).withColumnRenamed("code", "_start")
    return parts.join(of_parts, ["post_id", "part"]).select("post_id", "part", F.inline(scan(F.col("pieces"), F.col("_start"), "piece")))


#: Fields and what a write of each carries.
WRITES = {"scheduled": "struct<at:timestamp>", "error": "struct<text:string>", "outcome": "struct<at:timestamp,media:string,container:string>",
          "caption": "struct<text:string>", "hand": "struct<at:timestamp>", "image_order": "struct<text:string>", "note": "struct<text:string,at:timestamp>",
          "shared": "struct<at:timestamp>", "permalink": "struct<text:string>", "reset": "struct<at:timestamp>"}


def _writes(e: Column, state: Column) -> dict[str, list[tuple[Column, Column]]]:
    """Per field: when an event writes it, and what."""
    def is_a(*actions: str) -> Column:
        return e["act"].isin(*[ACTIONS.index(a) for a in actions])

    def of(**parts: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    null_text, null_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    movable, back = state.isin(PLANNED, FAILED, SKIPPED), is_a("requeue") & (state == PUBLISHED)
    reset = (is_a("retry") & state.isin(FAILED, SKIPPED)) | back
    note = F.nullif(F.trim(e["value"]), F.lit(""))
    return {
        "scheduled": [((is_a("reschedule") & movable) | (back & e["value_at"].isNotNull()), of(at=e["value_at"]))],
        "error": [(is_a("fail"), of(text=F.substring(e["value"], 1, 500))), (is_a("finish") | reset, of(text=null_text))],
        "outcome": [(is_a("finish"), of(at=e["at"], media=e["value"], container=e["other"])), (back, of(at=null_time, media=null_text, container=null_text))],
        "caption": [(is_a("caption") & movable, of(text=e["value"]))],
        "hand": [(is_a("caption") & movable & e["by_hand"], of(at=e["at"]))],
        "image_order": [(is_a("image_order") & movable, of(text=e["value"]))],
        "note": [(is_a("note"), of(text=note, at=F.when(note.isNotNull(), e["at"])))],
        "shared": [(is_a("share") & (state == PUBLISHED), of(at=e["at"])), (is_a("unshare") & (state == PUBLISHED), of(at=null_time))],
        "permalink": [(is_a("permalink"), of(text=e["value"])), (back, of(text=null_text))],
        "reset": [(reset, of(at=e["at"]))],
    }


def fold_posts(posts: DataFrame, events: DataFrame, max_attempts: int = 3, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The snapshot of posts after their events, in the order (at, seq).

    ``events`` has post_id, at, seq, action and, where an action needs them, value, other, value_at and
    by_hand. Claim, finish (value: media id, other: container), fail (value: message), skip, abandon,
    retry and requeue (value_at: new slot) move a post; reschedule, caption, image_order, note, share,
    unshare and permalink write fields. Moves and writes outside the states they are allowed in do nothing.

    The state before each event decides, so the fold is ordered; it is split all the same. Pieces of a
    post give maps over the finite (state, attempts) pairs; their composition gives the pair each piece
    begins with; then every piece is folded alone from there, and the last write of each field is an
    aggregate. Nothing holds more than a piece, whatever a post, a day or a second holds.

    Posts without events, events of unknown posts and unknown actions change nothing. A state that isn't
    known allows no guarded action and stays until an unguarded one replaces it. Attempts above the limit stay until they are reset.
    """
    changes = {"scheduled_at": ("scheduled", "at"), "error": ("error", "text"), "published_at": ("outcome", "at"), "media_id": ("outcome", "media"),
               "container_id": ("outcome", "container"), "caption": ("caption", "text"), "caption_edited_at": ("hand", "at"),
               "image_order": ("image_order", "text"), "note": ("note", "text"), "note_at": ("note", "at"), "story_shared_at": ("shared", "at"),
               "permalink": ("permalink", "text")}
    changes = {c: w for c, w in changes.items() if c in posts.columns}
    kept = {"reset"} | {field for field, _ in changes.values()}
    width = max_attempts + 1
    place = F.array_position(F.array(*[F.lit(s) for s in POST_STATES]), F.coalesce("state", F.lit("")))
    first = posts.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("post_id"), (F.when(place > 0, place - 1).otherwise(CLOSED) * width + F.least(F.coalesce("attempts", F.lit(0)), F.lit(max_attempts)))
        .cast("int").alias("first"))
    rows = pieces_of(events, piece_rows)
    starts = _start_codes(rows, first, max_attempts)
    runs = rows.groupBy("post_id", "part", "piece").agg(
        F.array_sort(F.collect_list(F.struct("row", "at", "act", "value", "other", "value_at", "by_hand"))).alias("run"))
    begun = (runs.join(starts, ["post_id", "part", "piece"], "left").join(first, "post_id")
             .withColumn("start", F.coalesce("code", "first")))
    tables = F.array(*[F.array(*[F.lit(c) for c in m]) for m in transitions(max_attempts)])

    def after(acc: Column, e: Column) -> Column:
        state = F.floor(acc["code"] / width).cast("int")
        code = F.when(e["act"] < len(MOVING), F.element_at(F.element_at(tables, e["act"] + 1), acc["code"] + 1)).otherwise(acc["code"])
        fields = []
        for name, writes in _writes(e, state).items():
            if name not in kept:
                continue
            found = acc[name]
            for when, what in writes:
                found = F.when(when, what.cast(WRITES[name])).otherwise(found)
            fields.append(found.alias(name))
        return F.struct(code.alias("code"), *fields)

    nothing = F.struct(F.col("start").alias("code"), *[F.lit(None).cast(t).alias(n) for n, t in WRITES.items() if n in kept])
    at = F.struct("part", "piece")
    folded = begun.select("post_id", "part", "piece", F.aggregate("run", nothing, after).alias("a")).select("post_id", "part", "piece", "a.*")
    last = folded.groupBy("post_id").agg(F.max_by("code", at).alias("_code"), *[
        F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(f"_{n}") for n in WRITES if n in kept])
    rows = posts.join(last, posts.id == last.post_id, "left")

    def written(field: str, part: str, old: str) -> Column:
        return F.when(F.col(f"_{field}").isNotNull(), F.col(f"_{field}.{part}")).otherwise(F.col(old))

    state, tries = F.floor(F.col("_code") / width), F.col("_code") % width
    return rows.withColumns({
        "state": F.when(F.col("_code").isNull() | (state == CLOSED), F.col("state")).otherwise(
            F.element_at(F.array(*[F.lit(s) for s in POST_STATES]), (state + 1).cast("int"))),
        "attempts": F.when(F.col("_code").isNull() | ((F.col("attempts") > max_attempts) & F.col("_reset").isNull()), F.col("attempts"))
        .otherwise(tries.cast("int")),
        **{c: written(f, p, c) for c, (f, p) in changes.items()},
    }).drop("post_id", "_code", *[f"_{n}" for n in kept])
