"""Column functions for URLs, paths, entries and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP methods of route entries; path parts that mark a front-end file; noise words of span names.
ENTRY_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "ALL"]
FRONTEND_PARTS = ["frontend", "client", "ui", "pages", "components", "views"]
NOISE_WORDS = ["middleware", "expressInit", "query", "cors", "bodyParser", "<anonymous>"]

DEFAULT_DEPTH, MAX_DEPTH = 8, 100


def _slashes(c: Column) -> Column:
    """Without slashes at the end, and with each run of slashes as one."""
    return F.regexp_replace(F.regexp_replace(c, "/+$", ""), "/{2,}", "/")


def normalize_url(url: Column) -> Column:
    """Lower case, trimmed, single slashes, none at the end; the mark dynamic: stays in front. '' and null: null."""
    dynamic = url.startswith("dynamic:")
    plain = lambda c: _slashes(F.trim(F.lower(c)))
    return F.when(url.isNull() | (url == ""), None).when(dynamic, F.concat(F.lit("dynamic:"), plain(F.substr(url, F.lit(9))))).otherwise(plain(url))


def route_match_key(normalized: Column) -> Column:
    """The key on which calls and routes meet: no dynamic: mark, every named segment as :param."""
    # Fixed: the form of a named segment.
    key = F.regexp_replace(F.regexp_replace(normalized, "^dynamic:", ""), "/:[a-zA-Z_][a-zA-Z0-9_]*", "/:param")
    return F.when(normalized == "", None).otherwise(key)


def merge_base_url(base: Column, path: Column) -> Column:
    """A relative path after its client's base URL; an absolute URL, a rooted path or a lone part is as it is. '' counts as null."""
    own = F.nullif(path, F.lit(""))
    relative = (base != "") & ~own.rlike("^(https?:/)?/")
    return F.when(relative, normalize_url(F.concat_ws("/", base, own))).otherwise(F.coalesce(own, F.nullif(base, F.lit(""))))


def normalize_path(path: Column) -> Column:
    """A route's path in lower case with single slashes; / where nothing is left; a dynamic: one as it is."""
    plain = _slashes(F.trim(F.lower(path)))
    return F.when(path.isNull() | (path == ""), "/").when(path.startswith("dynamic:"), path).otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit("/")))


def join_paths(base: Column, child: Column) -> Column:
    """A route's path below a mount prefix: the parts that aren't empty or / in a row; with two, either being dynamic makes the whole dynamic."""
    parts = F.filter(F.array(base, child), lambda p: p.isNotNull() & ~p.isin("", "/"))
    in_a_row = lambda change: F.array_join(F.transform(parts, change), "")
    dynamic = (F.size(parts) > 1) & F.exists(parts, lambda p: p.startswith("dynamic:"))
    return F.when(dynamic, F.concat(F.lit("dynamic:"), in_a_row(lambda p: F.regexp_replace(p, "^dynamic:", "")))).otherwise(normalize_path(in_a_row(normalize_path)))


def path_params(path: Column) -> Column:
    """array<struct<name, segment, segment_index>> of the segments :x and [x]."""
    parts = F.transform(F.split(path, "/"), lambda s, i: F.struct(F.regexp_replace(s, r"^:|^\[|\]$", "").alias("name"), s.alias("segment"), i.alias("segment_index")))
    named = F.filter(parts, lambda x: x["segment"].startswith(":") | x["segment"].rlike(r"^\[.+\]$"))
    none = F.array().cast("array<struct<name:string,segment:string,segment_index:int>>")
    return F.when(path.isNull() | path.startswith("dynamic:"), none).otherwise(named)


def route_pattern(path: Column) -> Column:
    """A regular expression for the paths that a route serves; all but the named segments is literal."""
    literal = F.regexp_replace(path, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(literal, r":[^\s/]+", "([^/]+)"), F.lit("$"))


def url_path(url: Column) -> Column:
    """The path of an http URL, / if it has none; anything else as it is."""
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.when(url.startswith("http") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), path).otherwise(url)


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def classify_entry(entry: Column) -> Column:
    """struct<type, method, path, event, element, name>: 'VERB path' is a route, 'onX' or 'onX:el' an event, else a function."""
    t = F.trim(F.coalesce(entry, F.lit("null")))
    # Fixed: the two patterns of entries.
    route, event = rf"^(?i)({'|'.join(ENTRY_METHODS)})\s+(\S+)$", r"^(on[A-Z][a-zA-Z]*)(?::(.+))?$"
    is_route, is_event = t.rlike(route), t.rlike(event)
    only = lambda cond, c: F.when(cond, c)
    return F.struct(
        F.when(is_route, "route").when(is_event, "event").otherwise("function").alias("type"),
        only(is_route, F.upper(F.regexp_extract(t, route, 1))).alias("method"),
        only(is_route, F.regexp_extract(t, route, 2)).alias("path"),
        only(~is_route & is_event, F.regexp_extract(t, event, 1)).alias("event"),
        only(~is_route & is_event, F.nullif(F.regexp_extract(t, event, 2), F.lit(""))).alias("element"),
        only(~is_route & ~is_event, t).alias("name"),
    )


def parse_repo_url(raw: Column) -> Column:
    """struct<owner, repo> of an ssh, http(s) or bare repository URL of the one host supported, else null."""
    t = F.trim(raw)
    ssh, web, bare = r"^(?i)git@github\.com:(.+)$", r"^(?i)https?://(?:[^/@]*@)?(?:www\.)?github\.com(?::\d+)?/([^?#]*)", r"^(?i)(?:www\.)?github\.com/(.+)$"
    path = F.when(t.rlike(ssh), F.regexp_extract(t, ssh, 1)).when(t.rlike("^(?i)https?://"), F.regexp_extract(t, web, 1)).otherwise(F.regexp_extract(t, bare, 1))
    parts = F.array_remove(F.split(F.get(F.split(path, "[?#]"), F.lit(0)), "/"), "")
    owner, repo = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"(?i)\.git$", "")
    good = owner.rlike("^[A-Za-z0-9_.-]+$") & repo.rlike("^[A-Za-z0-9_.-]+$")
    return F.when(good, F.struct(owner.alias("owner"), repo.alias("repo")))


def normalize_repo_url(raw: Column) -> Column:
    r = parse_repo_url(raw)
    return F.concat(F.lit("https://github.com/"), r["owner"], F.lit("/"), r["repo"])


def split_repo_url(url: Column, made_up: Column | None = None) -> Column:
    """struct<host, owner, repo> of any URL's host and first two path segments, https where it names no scheme.

    Missing segments are unknown and repo-<made_up>; what is no URL is local, local and project-<made_up>. made_up
    (by default new) tells such repositories apart.
    """
    label = F.lit("new") if made_up is None else made_up
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.try_parse_url(full, F.lit("HOST")))
    parts = F.array_remove(F.split(F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("")), "/"), "")
    repo = F.regexp_replace(F.get(parts, F.lit(1)), r"\.git", "")
    found = F.struct(host.alias("host"), F.coalesce(F.get(parts, F.lit(0)), F.lit("unknown")).alias("owner"), F.coalesce(repo, F.concat(F.lit("repo-"), label)).alias("repo"))
    local = F.struct(F.lit("local").alias("host"), F.lit("local").alias("owner"), F.concat(F.lit("project-"), label).alias("repo"))
    return F.when(host.isNull() | (host == ""), local).otherwise(found)


def archive_url(url: Column, branch: Column) -> Column:
    """Where the URL's host serves a branch as an archive; without a branch the default branch of each host."""
    r = split_repo_url(F.trim(url))
    main, master = F.coalesce(branch, F.lit("main")), F.coalesce(branch, F.lit("master"))
    own = F.concat(r["owner"], F.lit("/"), r["repo"])
    return (
        F.when(F.contains(r["host"], F.lit("gitlab.com")), F.concat(F.lit("https://gitlab.com/"), own, F.lit("/-/archive/"), master, F.lit("/"), r["repo"], F.lit("-"), master, F.lit(".zip")))
        .when(F.contains(r["host"], F.lit("bitbucket.org")), F.concat(F.lit("https://bitbucket.org/"), own, F.lit("/get/"), master, F.lit(".zip")))
        .otherwise(F.concat(F.lit("https://codeload.github.com/"), own, F.lit("/zip/refs/heads/"), main))
    )


def layer(file: Column) -> Column:
    """frontend or backend by parts of the path."""
    f = F.lower(file)
    front = f.endswith(".jsx")
    for part in FRONTEND_PARTS:
        front = front | F.contains(f, F.lit(part))
    return F.when(F.coalesce(front, F.lit(False)), "frontend").otherwise("backend")


def content_hash(file: Column, name: Column, start: Column, end: Column) -> Column:
    """First 12 hex digits of the SHA-1 of file::name::start::end."""
    return F.substring(F.sha1(F.concat_ws("::", file, name, start.cast("string"), end.cast("string"))), 1, 12)


def cache_key(label: Column, code: Column, question: Column | None = None) -> Column:
    key = F.concat_ws("::", label, F.substring(code, 1, 200))
    return key if question is None else F.concat_ws("::", key, F.substring(question, 1, 100))


def live_node_id(file: Column, line: Column, node_id: Column) -> Column:
    """file:line where both are there, else the node's own id."""
    return F.coalesce(F.concat(F.nullif(file, F.lit("")), F.lit(":"), line.cast("string")), node_id)


def health(average_ms: Column) -> Column:
    return F.when(average_ms > 1000, "CRITICAL").when(average_ms > 500, "WARNING").otherwise("HEALTHY")


def is_noise(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(NOISE_WORDS))


def clamp_depth(depth: int | None, least: int = 1, most: int = MAX_DEPTH, default: int = DEFAULT_DEPTH) -> int:
    return default if not depth or depth < 1 else max(least, min(most, depth))
