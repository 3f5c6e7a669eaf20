"""Names, labels, phrases and list cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole-name plurals and their singular.
SYNONYMS = {"drawers": "drawer", "handles": "handle", "doors": "door", "cabinets": "cabinet"}
# Action prefixes of an interactive object, in the order in which they are tried.
ACTIONS = (
    "hook_pull ", "hook pull ", "rotate ", "pull ", "push ", "twist ", "turn ", "press ",
    "pinch_pull ", "pinch pull ", "key_press ", "key press ", "unplug ",
)
# What stands for no prompt, and for no value in a list cell.
ABSENT = ("", "none", "n/a", "na")
# Prompts that name one kind of handle.
DOOR_HANDLE, TURNED_HANDLE = "door handle", "rotate door handle"
HANDLE_GROUP = "door_handle_group"
SPACE = r"[ \t\r\n\f]+"


def folded(c: Column) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalize_name(c: Column, keep_underscore: bool = True) -> Column:
    """Lower case, trimmed, blanks folded. With keep_underscore the plural synonyms apply;
    without it underscores are blanks and there are no synonyms."""
    c = F.lower(c) if keep_underscore else F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    c = folded(c)
    if not keep_underscore:
        return c
    out = c
    for many, one in SYNONYMS.items():
        out = F.when(c == many, F.lit(one)).otherwise(out)
    return out


def mask_parts(stem: Column, refined: bool = True, keep_underscore: bool = True) -> Column:
    """struct(type, name, inst) of a mask's file stem. A stem that begins with CTX names an object, with INT an
    affordance, any other an object. Parts stand between ``__``, or ``_`` where there is none; the tag is
    taken off the first part. The name is what stands before the first number (inst, in three digits at
    least) or area. With ``refined`` an instance_N__ prefix is skipped first."""
    return once(stem, lambda c: _mask_parts(F.trim(c), refined, keep_underscore))


def once(c: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def _mask_parts(s: Column, refined: bool, keep_underscore: bool) -> Column:
    if refined:
        s = F.regexp_replace(s, r"(?i)^instance_[0-9]+__", "")
    tag = lambda s: F.when(F.startswith(s, F.lit("CTX")), "CTX").when(F.startswith(s, F.lit("INT")), "INT")
    split = lambda s: F.filter(F.when(F.contains(s, F.lit("__")), F.split(s, "__")).otherwise(F.split(s, "_")), lambda p: p != "")
    stop = lambda rest: F.transform(rest, lambda p, i: F.when(F.regexp_like(p, F.lit(r"^([0-9]+|(?i:area)[0-9]+)$")), i))

    def rest(x):
        parts, first = x["parts"], F.get(x["parts"], F.lit(0))
        others = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
        return F.when(x["tag"].isNull() | first.isNull(), parts).when(first == x["tag"], others).when(F.startswith(first, x["tag"]), F.concat(F.array(F.substring(first, 4, 1 << 20)), others)).otherwise(parts)

    def named(x):
        name = F.trim(F.array_join(F.slice(x["rest"], F.lit(1), x["end"]), " "))
        number = F.get(x["rest"], x["end"])
        inst = F.when(F.regexp_like(number, F.lit("^[0-9]+$")), F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))).otherwise("000")
        return F.struct(F.when(x["tag"] == "INT", "affordance").otherwise("object").alias("type"), F.when(name == "", "unknown").otherwise(normalize_name(name, keep_underscore)).alias("name"), inst.alias("inst"))

    tagged = once(s, lambda s: F.struct(tag(s).alias("tag"), split(s).alias("parts")))
    cut = once(tagged, lambda x: F.struct(x["tag"].alias("tag"), rest(x).alias("rest")))
    return once(cut, lambda x: once(F.struct(x["tag"].alias("tag"), x["rest"].alias("rest"), F.coalesce(F.array_min(stop(x["rest"])), F.size(x["rest"])).alias("end")), named))


def natural_key(c: Column, digits: int = 20) -> Column:
    """An array that sorts names with their numbers by value."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), 1), lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]")), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), digits, "0")).otherwise(F.lower(p)))


# ------------------------------------------------------------------ phrases
def normalize_prompt(c: Column) -> Column:
    """Blanks folded; empty for null and for the words that stand for no prompt."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", ""))
    return F.when(F.lower(t).isin(*ABSENT), F.lit("")).otherwise(folded(t))


def is_absent(c: Column) -> Column:
    """Whether a value says that there is none."""
    return c.isNull() | F.lower(F.trim(c)).isin(*ABSENT)


def plain_words(c: Column) -> Column:
    """Lower case, with ``_`` and ``-`` as blanks, folded: how names and phrases are compared."""
    return folded(F.translate(F.lower(c), "_-", "  "))


def strip_action(c: Column) -> Column:
    """The phrase without the first action prefix that it begins with, in any case."""
    return normalize_prompt(F.regexp_replace(normalize_prompt(c), f"^(?i)({'|'.join(ACTIONS)})", ""))


def interactive_object(c: Column, first_only: bool = True) -> Column:
    """The object of a phrase: the first item of a comma list (unless first_only is off), without action;
    sockets and drawers by their usual name."""
    s = normalize_prompt(c)
    t = strip_action(F.split(s, ",")[0] if first_only else s)
    low = F.lower(t)
    return F.when(low == "socket opening", "socket").when(F.contains(low, F.lit("drawer")) & ~F.contains(low, F.lit("handle")), "drawer handle").otherwise(t)


def clean_phrase(c: Column) -> Column:
    """Lower case and folded; a phrase with the words socket and opening is a socket."""
    p = F.lower(folded(F.coalesce(c, F.lit(""))))
    words = F.split(p, r"[ \t_-]+")
    return F.when(F.array_contains(words, "socket") & F.array_contains(words, "opening"), F.lit("socket")).otherwise(p)


def handle_group(name: Column) -> Column:
    """The semantic group of a name: both kinds of door handle are one."""
    n = normalize_name(name, False)
    return F.when(n.isin(DOOR_HANDLE, TURNED_HANDLE), F.lit(HANDLE_GROUP)).otherwise(n)


def is_handle_like(name: Column) -> Column:
    return handle_group(name) == HANDLE_GROUP


def is_door_handle(prompt: Column) -> Column:
    """Whether a prompt says door handle and nothing else."""
    return F.coalesce(F.lower(F.trim(prompt)) == DOOR_HANDLE, F.lit(False))


def second_prompt(prompt: Column) -> Column:
    """The prompt that a door handle is tried with next; null for others."""
    return F.when(is_door_handle(prompt), F.lit(TURNED_HANDLE))


def video_prompt(prompt: Column, tag: Column) -> Column:
    p = normalize_prompt(prompt)
    return F.when((tag == "INT") & (F.lower(p) == DOOR_HANDLE), F.lit(TURNED_HANDLE)).otherwise(p)


# ------------------------------------------------------------------ lists
def distinct_by(items: Column, key) -> Column:
    """Items whose key doesn't come earlier in the array."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def prompt_list(items: Column) -> Column:
    """Prompts of an array of cells, comma lists taken apart, the first spelling of each kept."""
    parts = F.flatten(F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda v: v.isNotNull()), lambda v: F.split(v, ",")))
    return distinct_by(F.filter(F.transform(parts, normalize_prompt), lambda p: p != ""), F.lower)


def split_prompts(c: Column, sep: str = ";") -> Column:
    """Prompts between separators, folded, the first spelling of each kept."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), f"[{sep}]"), folded)
    return distinct_by(F.filter(parts, lambda p: p != ""), F.lower)


def _literal(c: Column) -> Column:
    """The strings of a list literal in JSON, or written with single quotes; null where it isn't one."""
    t = F.trim(c)
    quoted = F.when(~F.contains(t, F.lit('"')), F.replace(t, F.lit("'"), F.lit('"')))
    square = F.when(F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")")), F.concat(F.lit("["), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("]"))).otherwise(quoted)
    return F.when(F.startswith(t, F.lit("[")) | F.startswith(t, F.lit("(")), F.coalesce(F.from_json(t, "array<string>"), F.from_json(square, "array<string>")))


def _texts(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def list_cell(c: Column) -> Column:
    """A list literal, else the parts between the first of , ; | that occurs."""
    t = F.trim(F.coalesce(c, F.lit("")))
    sep = F.when(F.contains(t, F.lit(",")), ",").when(F.contains(t, F.lit(";")), ";").otherwise("|")
    plain = F.split(t, F.concat(F.lit("["), sep, F.lit("]")))
    return _texts(F.when(F.upper(t) == "N/A", F.array().cast("array<string>")).otherwise(F.coalesce(_literal(t), plain)))


def object_cell(c: Column) -> Column:
    """list_cell(), each part as it is compared: lower case, ``_`` and ``-`` as blanks."""
    return F.transform(list_cell(c), plain_words)


def single_or_list(c: Column) -> Column:
    """A list literal or a quoted string, else the whole cell as the only item."""
    t = F.trim(F.coalesce(c, F.lit("")))
    quote = F.regexp_extract(t, r"^(?:\"([^\"]*)\"|'([^']*)')$", 0)
    one = F.when(quote != "", F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    return _texts(F.coalesce(_literal(t), F.array(one)))


def all_objects(c: Column) -> Column:
    """Every object of a cell (a literal, or a comma list), normalised, each once."""
    s = F.trim(F.coalesce(c, F.lit("")))
    items = F.coalesce(_literal(s), F.split(s, ","))
    found = F.filter(F.transform(items, lambda x: interactive_object(x, False)), lambda x: x != "")
    return F.when(is_absent(c), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


# ------------------------------------------------------------------ file names and paths
def safe_name(c: Column) -> Column:
    """A node's name as a file name."""
    t = F.regexp_replace(F.regexp_replace(normalize_name(c), r"[^a-z0-9_.-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def class_name(c: Column) -> Column:
    """A prompt as the class part of a mask's file name."""
    t = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("_"))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9_-]+", "_"), "_+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown"))


def slug(c: Column, most: int = 80, default: str = "prompt") -> Column:
    """A prompt as a file name of at most so many characters."""
    t = F.regexp_replace(F.regexp_replace(F.lower(folded(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    t = F.coalesce(F.nullif(t, F.lit("")), F.lit(default))
    return F.when(F.length(t) > most, F.regexp_replace(F.substring(t, 1, most), "_+$", "")).otherwise(t)


def mask_name(tag: Column, cls: Column, number: Column, area: Column) -> Column:
    return F.format_string("%s__%s__%03d__area%d", tag, cls, number, area)


def instance_name(instance: Column, source: Column) -> Column:
    return F.concat(F.lit("instance_"), F.lpad(instance.cast("string"), 4, "0"), F.lit("__"), source)


def frame_path(base: Column, frame: Column) -> Column:
    """name.jpg as name_f0036.jpg; files without an ending get .jpg."""
    stem, end = F.regexp_replace(base, r"\.[^./]+$", ""), F.regexp_extract(base, r"(\.[^./]+)$", 1)
    return F.concat(stem, F.format_string("_f%04d", frame), F.coalesce(F.nullif(end, F.lit("")), F.lit(".jpg")))


def frame_numbers(specs: Column) -> Column:
    """Sorted distinct frames of an array of ``N`` and ``A-B``; a comma is an error."""
    some = F.filter(F.transform(specs, lambda s: F.trim(s)), lambda s: s != "")
    ends = F.transform(some, lambda s: F.when(F.contains(s, F.lit(",")), F.raise_error(F.concat(F.lit("no commas in frames: "), s)).cast("array<int>")).otherwise(F.transform(F.split(s, "-", 2), lambda x: F.trim(x).cast("int"))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(F.array_min(e), F.array_max(e))))))


# ------------------------------------------------------------------ what a model said
def first_object(c: Column) -> Column:
    """The text from the first ``{`` to the ``}`` that closes it, by counting braces; null if none does."""
    start = F.instr(c, "{")
    tail = F.substring(c, start, F.length(c))
    # a piece up to each closing brace; the first with as many of both is the object
    pieces = F.split(tail, "[}]")
    opened = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))))
    depth = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: F.aggregate(F.slice(opened, F.lit(1), k), F.lit(0), lambda a, x: a + x) - k)
    at = F.array_position(depth, 0)
    return F.when((start > 0) & (F.size(pieces) > 1) & (at > 0), F.concat(F.array_join(F.slice(pieces, F.lit(1), at.cast("int")), "}"), F.lit("}")))


def clamp01(c: Column) -> Column:
    """A number within [0, 1], from a number or its text; null where there is none."""
    v = c.try_cast("double")
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def whole_id(c: Column) -> Column:
    """An id from a whole number or its digits; null for anything else."""
    t = F.trim(c.cast("string"))
    return F.when(F.regexp_like(t, F.lit("^-?[0-9]+$")), t.try_cast("long"))


def number_text(c: Column) -> Column:
    """A double as the shortest text that reads back as it, in plain digits from 0.0001 to below 1e16 and as 1.5e-05 beyond."""
    t = c.cast("double").cast("string")
    sign, bare = F.when(t.startswith("-"), "-").otherwise(""), F.ltrim(t, F.lit("-"))
    power = F.substring_index(bare, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(bare, "E", 1), r"\.0$", ""), r"\.", "")
    short = F.regexp_replace(F.substring_index(bare, "E", 1), r"\.0$", "")
    shown = F.concat(short, F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    wide = F.rpad(digits, F.greatest(F.length(digits), power + 2), "0")
    large = F.concat(F.substring(wide, F.lit(1), power + 1), F.lit("."), F.substring(wide, power + 2, F.length(wide)))
    plain = F.when(power.between(-4, -1), small).when(power.between(0, 15), large).otherwise(shown)
    return F.when(F.contains(t, F.lit("E")), F.concat(sign, plain)).when(t == "NaN", "nan").when(F.contains(t, F.lit("Inf")), F.lower(F.regexp_replace(t, "inity", ""))).otherwise(t)


# ------------------------------------------------------------------ colours by name
def fnv1a(c: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits, as a long."""
    hexed = F.hex(F.encode(c, "UTF-8"))
    byte = F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed), F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(F.when(F.length(hexed) > 0, byte).otherwise(F.array().cast("array<bigint>")), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
