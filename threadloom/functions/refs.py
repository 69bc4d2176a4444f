"""References in text: web addresses, with and without scheme, that aren't local files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of names that are files rather than hosts.
FILE_ENDINGS = (
    "adoc astro awk bash bat bib c cc cfg clj cljs cmake conf cpp cr cs csh css csv dart diff env erb ex exs fish fs gemspec go graphql groovy h haml hbs heex hh hpp hs htm html "
    "ini ipynb java js json jsonl jsonnet jsx kt kts less lhs lock lua m md mdx mk mm nix patch pdf php plist proto ps1 psm1 py pyi r rake rb rst rs scala scss sh sol sql svelte "
    "svg swift tex toml twig ts tsx tsv txt vim vue wasm xml yaml yml zsh"
).split()

#: Schemes, labels and hosts have the longest lengths that names may have, or more: an unbounded repeated group would
#: take a stack frame of Java's matcher for each label, an unbounded scheme a scan of the text from each letter.
ADDRESS = (
    r"(?i)(?<![\w@.\-/])(?:[a-z][a-z0-9+.\-]{0,63}://[^\s<>\"'`]+"
    r"|(?:[a-z0-9](?:[a-z0-9\-]{0,251}[a-z0-9])?\.){1,126}[a-z]{2,}(?::\d+)?(?:/[^\s<>\"'`]*)?)"
)


def trimmed(raw: Column) -> Column:
    """Without punctuation that ends a sentence or closes a bracket."""
    return F.rtrim(raw, F.lit(".,;:)]}"))


def is_local_file(value: Column) -> Column:
    """Without scheme: a name with a file's ending, perhaps under folders, perhaps with line numbers."""
    low = F.lower(value)
    bare = F.regexp_replace(low, r":\d+(-\d+)?\z", "")
    ending = F.regexp_extract(bare, r"[^/]\.([a-z0-9]+)/*\z", 1)
    first = F.regexp_extract(low, r"^/*([^/]+)", 1)
    host_first = first.contains(".") & ~F.regexp_extract(first, r".\.([a-z0-9]+)\z", 1).isin(FILE_ENDINGS)
    file_like = ending.isin(FILE_ENDINGS) & ~(low.contains("/") & host_first) & (bare != "docs.rs")
    return ~low.contains("://") & ~low.startswith("www.") & file_like


def normalized(value: Column) -> Column:
    """With scheme, host in lower case and a path; null unless http or https."""
    full = F.when(value.contains("://"), value).otherwise(F.concat(F.lit("https://"), value))
    scheme, host = F.lower(F.regexp_extract(full, r"^([A-Za-z][\w+.\-]*)://", 1)), F.lower(F.regexp_extract(full, r"://([^/?#]*)", 1))
    port = F.when(scheme == "http", F.regexp_replace(host, r":80\z", "")).otherwise(F.regexp_replace(host, r":443\z", ""))
    rest = F.regexp_extract(full, r"://[^/?#]*(.*)\z", 1)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), port, path))


def host(normal: Column) -> Column:
    return F.try_parse_url(normal, F.lit("HOST"))


def extract(text: Column) -> Column:
    """Array of struct(value, normalized_value, host) in order; repeats of one value count once."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), trimmed)
    real = F.filter(F.array_distinct(raw), lambda v: (v != "") & ~is_local_file(v))
    return F.transform(real, lambda v: F.struct(v.alias("value"), normalized(v).alias("normalized_value"), host(normalized(v)).alias("host")))


def summary(refs: Column) -> Column:
    """``url`` or ``n urls``; nothing for none."""
    n = F.size(refs)
    return F.when(n <= 0, F.lit("")).when(n == 1, F.lit("url")).otherwise(F.concat(n.cast("string"), F.lit(" urls")))
