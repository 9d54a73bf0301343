"""Column functions of the text layer. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------

MIN_LENGTH = 25
FAST_MODEL_THRESHOLD = 300

NOISE_PHRASES = [
    "ok", "okay", "got it", "thanks", "thank you", "lol", "haha", "sure", "noted",
    "sounds good", "will do", "👍", "👌", "✅", "done", "yep", "yup", "nope", "yes",
    "no", "agreed", "nice", "+1", ":+1:", ":white_check_mark:", ":thumbsup:",
]

BOT_SUBTYPES = ["bot_message", "channel_join", "channel_leave", "channel_topic", "channel_purpose"]

RELATIONSHIP_PHRASES = [
    "who owns", "who manages", "who works on", "who is assigned", "who leads",
    "who handles", "who is responsible", "who reports", "which projects",
    "which clients", "which teams", "what does", "tell me about", "everything about",
]

# Characters that count as white space when text is stripped.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# The same set for use inside a regular-expression class.
SPACE = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD = r"\p{L}\p{N}_"

FOOTERS = [
    rf"\*?Sent using\*?[{SPACE}]+Claude\.?",
    rf"\*?Sent via\*?[{SPACE}]+Claude\.?",
    rf"\*?Powered by\*?[{SPACE}]+Claude\.?",
    rf"\*?Sent using\*?[{SPACE}]+ChatGPT\.?",
    rf"\*?Sent via\*?[{SPACE}]+ChatGPT\.?",
    rf"\*?Sent with\*?[{SPACE}]+[{WORD}]+AI\.?",
]
EMOJI_ONLY = rf"^[{SPACE}:a-z_]+:$|^[\x{{1F300}}-\x{{1FFFF}}{SPACE}]+$"

# -----------------------------------------------------------------------------


def strip(col: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def or_else(col: Column, default) -> Column:
    """``default`` where the value is null or empty."""
    return F.coalesce(F.nullif(col, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def clean_text(col: Column) -> Column:
    """Drop app footers wherever they occur, then strip."""
    # One cheap look decides whether the six replacements run at all.
    cleaned = reduce(lambda c, p: F.regexp_replace(c, f"(?iu){p}", ""), FOOTERS, col)
    return strip(F.when(col.rlike(r"(?iu)sent (using|via|with)|powered by"), cleaned).otherwise(col))


def is_emoji_only(col: Column) -> Column:
    return col.rlike(f"(?iu){EMOJI_ONLY}")


def is_bot(subtype: Column, user: Column) -> Column:
    return F.coalesce(subtype.isin(BOT_SUBTYPES), F.lit(False)) | F.coalesce(
        user.startswith("B"), F.lit(False)
    )


def skip_reason(content: Column, subtype: Column, user: Column) -> Column:
    """Why a message is noise, null where it is kept. The first rule that holds wins."""
    body = strip(content)
    return (
        F.when(content.isNull() | (body == ""), "blank")
        .when(F.length(body) < MIN_LENGTH, "short")
        .when(F.lower(body).isin(NOISE_PHRASES), "phrase")
        .when(is_emoji_only(body), "emoji")
        .when(F.coalesce(subtype.isin(BOT_SUBTYPES), F.lit(False)), "bot_subtype")
        .when(F.coalesce(user.startswith("B"), F.lit(False)), "bot_user")
    )


def permalink(domain: Column, channel: Column, ts: Column) -> Column:
    """Message link; the raw timestamp where the workspace is unknown."""
    host = F.replace(domain, F.lit(".slack.com"), F.lit(""))
    link = F.concat(F.lit("https://"), host, F.lit(".slack.com/archives/"), channel,
                    F.lit("/p"), F.replace(ts, F.lit("."), F.lit("")))
    return F.when(F.coalesce(domain, F.lit("")) == "", ts).otherwise(link)


def asks_for_relationships(question: Column) -> Column:
    low = F.lower(question)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(p) for p in RELATIONSHIP_PHRASES]),
                      F.lit(False))


def model_tier(content: Column) -> Column:
    return F.when(F.length(content) < FAST_MODEL_THRESHOLD, "fast").otherwise("full")


def strip_fence(reply: Column) -> Column:
    """Inside of a leading code fence without its ``json`` mark; other text only stripped."""
    inner = F.regexp_replace(F.split(reply, "```", 3).getItem(1), "^json", "")
    return strip(F.when(reply.startswith("```"), inner).otherwise(reply))


def decode_base64url(data: Column) -> Column:
    """URL-safe base64 to text, with or without padding; bytes that are not UTF-8 are dropped, other text is null."""
    plain = F.regexp_replace(F.translate(data, "-_", "+/"), r"[\s=]", "")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    raw = F.try_to_binary(padded, F.lit("base64"))
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def extension(filename: Column) -> Column:
    """Lower-case extension with its dot, empty where there is none."""
    return F.when(filename.contains("."),
                  F.concat(F.lit("."), F.lower(F.substring_index(filename, ".", -1)))).otherwise("")


def inbound_address(org_id: Column, domain: str) -> Column:
    return F.concat(F.split_part(org_id, F.lit("-"), F.lit(1)), F.lit(f"@{domain}"))
