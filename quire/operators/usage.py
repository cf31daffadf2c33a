"""Event logs: usage, budgets, rate limits, and what an error means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.folds import folded


def rolled_up(events: DataFrame, scope: str, tokens: str) -> DataFrame:
    """Requests and tokens per scope and in all (scope null)."""
    return events.rollup(scope).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))


def deltas(events: DataFrame, key: str, order: list[Column], counter: str) -> DataFrame:
    """What a counter's snapshots add, never less than 0."""
    before = F.lag(counter).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("delta", F.greatest(F.lit(0), F.col(counter) - F.coalesce(before, F.lit(0))))


def cost(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    return F.round((F.greatest(F.lit(0), prompt) * price_in + F.greatest(F.lit(0), completion) * price_out) / 1_000_000, 6)


def tail(events: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[o.desc() for o in order])
    return events.withColumn("q", F.row_number().over(w)).where(F.col("q") <= most).drop("q")


def admitted(events: DataFrame, key: str, order: list[str], price: str, limit: float) -> DataFrame:
    """Whether each request fits into its key's budget: a refused one costs nothing, so that later cheaper
    ones may pass. Whole cents keep sums exact; a key's requests stream by in order."""

    def step(spent: int, row: tuple) -> tuple[int, tuple]:
        ok = spent + row[0] <= limit
        return (spent + row[0] if ok else spent), (ok,)

    return folded(events.select(key, *order, price), key, [F.col(c) for c in (*order, price)], [price], 0, step, "admitted boolean")


def settled(requests: DataFrame, key: str, order: list[str], estimate: str, actual: str, limit: float) -> DataFrame:
    """Requests with estimates and, once they are done, actual costs: each reserves its estimate, and settles it
    before the next one of its key. Gives admitted, and spent after it: the larger of what was estimated and what
    was paid so far."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        guessed, paid = state
        guess, cost = row
        ok = max(guessed, paid) + guess <= limit
        if ok:
            guessed, paid = guessed + guess, paid + (cost or 0)
        return (guessed, paid), (ok, max(guessed, paid))

    return folded(requests.select(key, *order, estimate, actual), key, [F.col(c) for c in order], [estimate, actual], (0, 0), step, "admitted boolean, spent long")


def rate_limited(events: DataFrame, key: str, at: str, id_: str, tokens: str, most_requests: int, most_tokens: int, window: int) -> DataFrame:
    """The delay of each request under a fixed window that starts with its first request, in whole seconds
    of a virtual clock that waits as callers would. A request larger than the window's tokens passes after
    a reset. A key's requests stream by in order."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        clock, begun, requests, used = state
        when, size = row
        now = max(clock, when)
        if now - begun >= window:
            begun, requests, used = now, 0, 0
        delay = 0
        if requests + 1 > most_requests or used + size > most_tokens:
            delay = window - (now - begun)
            begun, requests, used = now + delay, 0, 0
        return (now + delay, begun, requests + 1, used + size), (delay,)

    x = folded(events.select(key, at, id_, tokens), key, [F.col(at), F.col(id_), F.col(tokens)], [at, tokens], (0, -(1 << 60), 0, 0), step, "delay long")
    return x.select(key, id_, "delay")


def counters(calls: DataFrame, scope: str, price_in: float, price_out: float) -> DataFrame:
    """Per scope and in all (scope null): requests and tokens used, the same estimated, what both cost, and the
    larger cost as what is spent. calls has requests, prompt_tokens, completion_tokens (what each added) and
    estimated_prompt_tokens, estimated_completion_tokens (null where nothing was estimated). Costs are rounded to
    a millionth a call, as they are booked."""
    known = F.col("estimated_prompt_tokens").isNotNull()
    x = calls.withColumn("actual_cost", cost(F.col("prompt_tokens"), F.col("completion_tokens"), price_in, price_out))
    x = x.withColumn("estimated_cost", F.when(known, cost(F.col("estimated_prompt_tokens"), F.col("estimated_completion_tokens"), price_in, price_out)).otherwise(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    out = x.rollup(scope).agg(
        *[total(c) for c in ("requests", "prompt_tokens", "completion_tokens")], F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).cast("long").alias("total_tokens"),
        F.count_if(known).alias("estimated_requests"), total("estimated_prompt_tokens"), total("estimated_completion_tokens"),
        F.coalesce(F.sum(F.col("estimated_prompt_tokens") + F.col("estimated_completion_tokens")), F.lit(0)).cast("long").alias("estimated_total_tokens"),
        F.round(F.sum("actual_cost"), 6).alias("actual_cost"), F.round(F.sum("estimated_cost"), 6).alias("estimated_cost"),
    )
    return out.withColumn("budget_spent", F.greatest("actual_cost", "estimated_cost"))


def number_in(usage: Column, *names: str) -> Column:
    """The first of some keys of a JSON object that holds a number (truth values are none), as a whole number of at
    least 0."""
    found = [F.get_json_object(usage, f"$.{n}") for n in names]
    return F.greatest(F.lit(0), F.floor(F.coalesce(*[F.when(x.rlike(r"^-?[0-9]"), x).try_cast("double") for x in found], F.lit(0.0)))).cast("long")


#: The first pattern that an error's lower-case text holds gives its code, owner and whether
#: trying again may help.
LADDER = (
    ("upload exceeds configured limit|request entity too large", "upload-too-large", "source_file", False),
    ("requires calibre|ebook-convert.*not found|not found.*ebook-convert", "converter-unavailable", "environment", False),
    ("ebook-convert timed out", "conversion-timeout", "source_file", True),
    ("bad zip|not a zip file|path traversal|encrypted", "invalid-source-file", "source_file", False),
    ("no translatable|0 translatable", "no-text-detected", "source_file", False),
    (r"provider http\s+(401|403)|api key|unauthorized", "provider-authentication", "api", False),
    ("provider http 429|rate limit", "provider-rate-limit", "api", True),
    ("timed out|timeout", "provider-timeout", "api", True),
    ("context.*(length|large|token)|(length|large|token).*context|request too large", "provider-context-limit", "api", True),
    (r"provider http\s+5\d\d", "provider-error", "api", True),
    ("provider http|unexpected openai|unexpected anthropic", "provider-error", "api", False),
    ("validation|invalid json|missing translated row", "invalid-provider-output", "api", True),
)


def diagnosed(detail: Column, stage: Column) -> Column:
    """struct<code, owner, retryable> of an error."""
    low = F.lower(F.trim(detail))
    make = lambda code, owner, again: F.struct(F.lit(code).alias("code"), F.lit(owner).alias("owner"), F.lit(again).alias("retryable"))
    out = None
    for pattern, code, owner, again in LADDER:
        out = (F if out is None else out).when(low.rlike("(?s)" + pattern), make(code, owner, again))
    return out.when(stage.isin("package", "audit"), make("output-build-failed", "engine", False)).otherwise(make("unexpected-error", "unknown", False))


def retryable(message: Column) -> Column:
    """Whether a provider's error may pass: time-outs, 429 and 5xx."""
    low = F.lower(message)
    status = F.regexp_extract(low, r"provider http\s+(\d{3})", 1).try_cast("int")
    return low.rlike("timed out|timeout") | F.coalesce((status == 429) | status.between(500, 599), F.lit(False))


#: What an error of output shape, a refusal, and an error that smaller batches may avoid hold.
SHAPE = "provider returned invalid jsonl|has validation issues|missing translated row|structural id/href/src tokens changed|invalid translated_html xml snippet"
REFUSED = "considered high risk|request was rejected|safety"


def output_retryable(message: Column, is_value_error: Column) -> Column:
    """Whether an error of a reply's shape may pass."""
    return is_value_error & F.lower(message).rlike(SHAPE)


def refused(message: Column, is_value_error: Column) -> Column:
    """Whether a service declined to answer."""
    low = F.lower(message)
    return is_value_error & F.contains(low, F.lit("provider returned invalid jsonl")) & low.rlike(REFUSED)


def worth_splitting(message: Column, is_value_error: Column) -> Column:
    """Whether smaller batches may help: time-outs, too long a context, a reply's shape or a refusal."""
    low = F.lower(message)
    return low.rlike("timed out|timeout|context.*(?:length|large|token)|request too large") | output_retryable(message, is_value_error) | refused(message, is_value_error)


#: What to tell a user about each code: title and guidance, in our own words.
ADVICE = {
    "upload-too-large": ("The file is larger than allowed", "Compress it or raise the limit."),
    "converter-unavailable": ("A converter is missing", "Install one or give the book as EPUB."),
    "conversion-timeout": ("The conversion took too long", "Check the file, or allow more time."),
    "invalid-source-file": ("The file is damaged, encrypted or unsafe", "Export it again without protection."),
    "no-text-detected": ("There is no text to work on", "Run text recognition first."),
    "provider-authentication": ("The service refused the credentials", "Check key, address and model."),
    "provider-rate-limit": ("The service limits requests", "Wait, or lower the number of requests at once."),
    "provider-timeout": ("The service did not answer in time", "Try again with smaller batches or more time."),
    "provider-context-limit": ("The request is too long for the model", "Use smaller batches."),
    "provider-error": ("The service failed", "Try again later, or check the settings."),
    "invalid-provider-output": ("The reply is not of the form asked for", "Try again, or use another model."),
    "output-build-failed": ("The result could not be built", "Check the source's structure."),
    "unexpected-error": ("This step failed", "Try again, and report the details."),
}


def advised(code: Column) -> Column:
    """struct<title, guidance> of a code."""
    out = None
    for c, (title, guidance) in ADVICE.items():
        out = (F if out is None else out).when(code == c, F.struct(F.lit(title).alias("title"), F.lit(guidance).alias("guidance")))
    return out


#: What has happened, by code, in our own words; of what has no code the error itself is told.
MESSAGES = {
    "upload-too-large": "The file was refused before any work began.", "converter-unavailable": "This format can't be read here as it is.", "conversion-timeout": "The file may be scanned, damaged or unusually large.",
    "invalid-source-file": "The file couldn't be opened safely.", "no-text-detected": "The file seems to hold pictures of text only.", "provider-authentication": "The file is fine; the service didn't accept the account.",
    "provider-rate-limit": "Too many requests were made, or the account's quota is used up.", "provider-timeout": "What was asked for at once took too long; smaller requests are made where that helps.", "provider-context-limit": "The file is fine; a request had more text than the model takes.",
    "provider-error": "The service was reached but couldn't do what was asked.", "invalid-provider-output": "What came back would have harmed the book's structure, and was left.", "output-build-failed": "All parts are there, but they couldn't be put together or checked.",
}


def explained(detail: Column, stage: Column) -> Column:
    """struct<code, owner, retryable, title, message, guidance, detail> of an error; a blank one is unknown."""
    said = F.coalesce(F.nullif(F.trim(detail), F.lit("")), F.lit("Unknown error"))
    d = diagnosed(said, stage)
    message = None
    for code, text in MESSAGES.items():
        message = (F if message is None else message).when(d["code"] == code, text)
    a = advised(d["code"])
    return F.struct(d["code"].alias("code"), d["owner"].alias("owner"), d["retryable"].alias("retryable"), a["title"].alias("title"), message.otherwise(said).alias("message"), a["guidance"].alias("guidance"), said.alias("detail"))
