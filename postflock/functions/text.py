"""Functions of a post's text, as Spark expressions.

Tokens are cut at space, tab, newline, carriage return and form feed only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BREAKS = r"[ \t\n\r\f]+"
MARKERS = ("RT", "RT:")
DOMAINS = (".com", ".gov", ".org", ".net", ".edu", ".cn")
LETTERS = 35
LEAST_PART = 3


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, BREAKS), lambda x: x != "")


# The functions below may be given the text's tokens, if several of them are used.


def _given(text: Column, t: Column | None) -> Column:
    return tokens(text) if t is None else t


def _count(items: Column) -> Column:
    return F.size(items).cast("bigint")


def count_words(text: Column, t: Column | None = None) -> Column:
    return _count(_given(text, t))


def count_chars(text: Column, t: Column | None = None) -> Column:
    """Length in UTF-16 units, white space included."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def is_hashtag(token: Column) -> Column:
    return F.startswith(token, F.lit("#")) & (F.length(token) > 1)


def count_hashtags(text: Column, t: Column | None = None) -> Column:
    return _count(F.filter(_given(text, t), is_hashtag))


def is_url(token: Column) -> Column:
    """Case matters; a domain at the very start does not count."""
    found = F.startswith(token, F.lit("http://"))
    for domain in DOMAINS:
        found = found | (F.instr(token, domain) > 1)
    return found


def count_urls(text: Column, t: Column | None = None) -> Column:
    return _count(F.filter(_given(text, t), is_url))


def is_marker(token: Column) -> Column:
    return token.isin(*MARKERS)


def is_retweet(text: Column, t: Column | None = None) -> Column:
    return F.exists(_given(text, t), is_marker)


def is_original(text: Column, t: Column | None = None) -> Column:
    return ~is_retweet(text, t)


def is_mention(token: Column) -> Column:
    return F.startswith(token, F.lit("@"))


def bare_name(token: Column) -> Column:
    """The token without its @ and one closing colon."""
    name = F.substr(token, F.lit(2))
    return F.when(F.endswith(name, F.lit(":")), F.substr(name, F.lit(1), F.length(name) - 1)).otherwise(name)


def user_of(token: Column) -> Column:
    return F.lower(bare_name(token))


def _before_marker(found: Column) -> Column:
    first = F.least(*[F.when(F.array_contains(found, m), F.array_position(found, m)) for m in MARKERS])
    return F.when(first.isNull(), found).otherwise(F.slice(found, F.lit(1), (first - 1).cast("int")))


def mentioned_users(text: Column, t: Column | None = None) -> Column:
    """Names, in lower case, of mentions before the first retweet marker; repeated
    and empty ones stay."""
    names = lambda found: F.transform(F.filter(_before_marker(found), is_mention), user_of)
    return let(tokens(text), names) if t is None else names(t)


def count_mentions(text: Column, t: Column | None = None) -> Column:
    return _count(mentioned_users(text, t))


def retweeted_user(text: Column) -> Column:
    """The user after the first marker that a mention follows. The token after a
    marker is used up, whatever it is. Null if there is none; may be empty."""
    start = F.struct(F.lit(False).alias("after"), F.lit(None).cast("string").alias("user"))

    def step(s: Column, t: Column) -> Column:
        user = F.when(s["user"].isNull() & s["after"] & is_mention(t), user_of(t)).otherwise(s["user"])
        return F.struct((~s["after"] & is_marker(t)).alias("after"), user.alias("user"))

    return F.aggregate(tokens(text), start, step, lambda s: s["user"])


def retweeted_part(text: Column) -> Column:
    """Struct (user, part, letters) of a retweet's original: what follows the last
    marker, the last user named right after one, and the part's first letters a to
    z. Null without user, or if the part is too short."""
    start = F.struct(F.lit(False).alias("after"), F.lit(0).alias("at"), F.lit(0).alias("begin"), F.lit(None).cast("string").alias("user"))

    def step(s: Column, t: Column) -> Column:
        """The place of the token, that where the part begins, and the user."""
        opens = ~s["after"] & is_marker(t)
        used = s["after"] & (is_mention(t) | is_marker(t))
        at = s["at"] + 1
        begin = F.when(opens | used, at + 1).otherwise(s["begin"])
        return F.struct(opens.alias("after"), at.alias("at"), begin.alias("begin"), F.when(s["after"] & is_mention(t), bare_name(t)).otherwise(s["user"]).alias("user"))

    def whole(t: Column) -> Column:
        return let(F.aggregate(t, start, step), lambda s: let(F.struct(s["user"].alias("user"), F.array_join(F.slice(t, s["begin"], F.size(t)), " ").alias("kept")), finish))

    def finish(s: Column) -> Column:
        part = F.regexp_replace(s["kept"], r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
        letters = F.substring(F.regexp_replace(F.lower(part), "[^a-z]", ""), 1, LETTERS)
        out = F.struct(F.lower(s["user"]).alias("user"), part.alias("part"), letters.alias("letters"))
        return F.when((F.length(s["user"]) > 0) & (count_chars(part) >= LEAST_PART), out)

    # few texts are retweets; only theirs are read token by token
    return let(tokens(text), lambda t: F.when(F.exists(t, is_marker), whole(t)))


def mentions_user(text: Column, user: Column) -> Column:
    """Whether any mention, also after a marker, names the user."""
    return F.exists(tokens(text), lambda t: is_mention(t) & (user_of(t) == user))
