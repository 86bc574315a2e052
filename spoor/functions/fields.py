"""Fields of a trace record: escapes, quoting, names, receivers. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private code points stand for escaped characters while separators are being replaced. The emitter
#: escapes everything beyond ASCII; fields of a body that holds one of them all the same can't be read.
_BACKSLASH, _COLON = "\ue000", "\ue001"
_SPLIT = {"allowUnquotedControlChars": "true", "maxStringLen": "2147483647"}


def split_fields(body: Column) -> Column:
    """The fields of a record's body, unescaped: array<string>.

    Separators are colons; \\: and \\\\ stand for themselves, \\xNN and \\uNNNN for code units (surrogate
    pairs join), any other escaped character for itself; bad digits give a NUL. An empty body has no
    fields; a closing separator gives an empty last field; a body with the two code points used inside has
    null. The body is rewritten into a JSON array, so the
    split runs inside the JVM.
    """
    json = F.replace(body, F.lit("\\\\"), F.lit(_BACKSLASH))
    json = F.replace(json, F.lit("\\:"), F.lit(_COLON))
    json = F.regexp_replace(json, r"(?s)\\x(?![0-9a-fA-F]{2}).{0,2}", r"\\u0000")
    json = F.regexp_replace(json, r"(?s)\\u(?![0-9a-fA-F]{4}).{0,4}", r"\\u0000")
    json = F.regexp_replace(json, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    json = F.regexp_replace(json, r"(?s)\\(?!u[0-9a-fA-F]{4})(.)", "$1")
    json = F.regexp_replace(json, r"\\$", "")
    json = F.replace(json, F.lit('"'), F.lit('\\"'))
    json = F.replace(json, F.lit(":"), F.lit('","'))
    json = F.replace(F.replace(json, F.lit(_COLON), F.lit(":")), F.lit(_BACKSLASH), F.lit("\\\\"))
    fields = F.from_json(F.concat(F.lit('["'), json, F.lit('"]')), "array<string>", _SPLIT)
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).when(~body.rlike(f"[{_BACKSLASH}{_COLON}]"), fields)


def pack_fields(fields: Column) -> Column:
    """The inverse of split_fields for text without supplementary characters' halves: one escaped body."""
    def one(f: Column) -> Column:
        f = F.regexp_replace(f, r"([\\:])", r"\\$1")
        plain = f
        for c in "\t\n\r":
            plain = F.replace(plain, F.lit(c), F.lit(f"\\x{ord(c):02x}"))
        each = F.array_join(F.transform(F.split(f, ""), _escape), "")  # character by character, where it must be
        return F.when(f.rlike(r"[^\t\n\r -~]"), each).otherwise(plain)

    return F.array_join(F.transform(fields, one), ":")


def _escape(c: Column) -> Column:
    code = F.ascii(c)  # the code point of the first character
    low, unit = F.format_string("\\x%02x", code), F.format_string("\\u%04x", code)
    high = code - 0x10000
    pair = F.format_string("\\u%04x\\u%04x", F.lit(0xD800) + F.shiftright(high, 10), F.lit(0xDC00) + high.bitwiseAND(F.lit(0x3FF)))
    return F.when((c == "") | code.between(0x20, 0x7E), c).when(code < 0x20, low).when(code < 0x10000, unit).otherwise(pair)


def strip_pair(c: Column, left: str, right: str) -> Column:
    """Without one pair of enclosing characters, if it has both."""
    return F.when(has_pair(c, left, right), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def has_pair(c: Column, left: str, right: str) -> Column:
    return (F.length(c) >= 2) & c.startswith(left) & c.endswith(right)


def strip_quotes(c: Column) -> Column:
    return strip_pair(c, '"', '"')


def strip_curlies(c: Column) -> Column:
    return strip_pair(c, "{", "}")


def is_noise(name: Column) -> Column:
    """Names that no analysis counts: unknown, anonymous, or a whole number of 64 bits."""
    return name.isin("?", "<anonymous>") | (name.rlike("^[+-]?[0-9]+$") & name.try_cast("long").isNotNull())


def receiver_tag(receiver: Column) -> Column:
    """The constructor of a receiver with an object id; other receivers as they are. Braces go first."""
    bare = strip_curlies(receiver)
    return F.when(F.instr(bare, ",") > 0, F.get(F.split(bare, ","), F.lit(1))).otherwise(bare)


def native_name(name: Column) -> Column:
    """A function's name without the mark of a native one."""
    return F.regexp_replace(name, "^%", "")


def receiver_of(op: Column, fields: Column) -> Column:
    at = lambda i: F.get(fields, F.lit(i))
    return F.when(op.isin("g", "s"), at(1)).when(op == "c", at(2)).when(op == "n", native_name(strip_curlies(at(1))))


def member_of(op: Column, fields: Column) -> Column:
    at = lambda i: F.get(fields, F.lit(i))
    return F.when(op.isin("g", "s"), strip_quotes(at(2))).when(op == "c", native_name(strip_quotes(at(1)))).when(op == "n", F.lit(""))


def arguments_of(op: Column, fields: Column) -> Column:
    """Call arguments, or the value of a set."""
    first = F.when(op == "n", 3).otherwise(4)
    return F.when(op.isin("c", "n", "s") & (F.size(fields) >= first), F.slice(fields, first, F.size(fields))).otherwise(F.array().cast("array<string>"))


def full_name(receiver: Column, member: Column) -> Column:
    return F.when((member == "") | member.isNull(), receiver).otherwise(F.concat(receiver, F.lit("."), member))


def value(lexeme: Column) -> Column:
    """struct(tag, text, number, flag) of a logged value."""
    names = {"#T": "true", "#F": "false", "#N": "null", "#U": "undefined", "#?": "other", "?": "unknown"}
    tag = F.lit("function")
    tag = F.when(lexeme.rlike(r"^[-+0-9.]") & lexeme.try_cast("double").isNotNull(), "number").otherwise(tag)
    tag = F.when(has_pair(lexeme, "/", "/"), "regexp").when(has_pair(lexeme, "{", "}"), "object").when(has_pair(lexeme, '"', '"'), "string").otherwise(tag)
    for mark, name in names.items():
        tag = F.when(lexeme == mark, name).otherwise(tag)
    flag = F.when(lexeme == "#T", True).when(lexeme == "#F", False)
    return F.struct(tag.alias("tag"), F.when(tag == "string", strip_quotes(lexeme)).when(tag.isin("regexp", "object", "function"), lexeme).alias("text"), F.when(tag == "number", lexeme.try_cast("double")).alias("number"), flag.alias("flag"))


def object_dump(lexeme: Column) -> Column:
    """The keys and values of a shallow dump {hash,k\\:v,...}, whose colons the field codec has unescaped: map<string,string>."""
    parts = F.filter(F.slice(F.split(strip_curlies(lexeme), ","), 2, 1 << 30), lambda p: F.instr(p, ":") > 0)
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).alias("key"), F.substring(p, F.instr(p, ":") + 1, F.length(p)).alias("value")))
    last = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))))
    return F.when(has_pair(lexeme, "{", "}"), last)
