"""Repository URLs as columns: parse, check, build, display."""

from pyspark.sql import Column, functions as F

from siftmoor.functions.text import strip

# FIXED VALUES: host names, URL forms and messages
HOSTS = ["github.com", "www.github.com"]
SSH = r"^git@github\.com:(.+?)/(.+?)(?:\.git)?$"
SSH_START = r"^git@github\.com:.+/.+"
NAME = r"^[\p{L}\p{N}_.-]+\n?$"
CLONE, ZIP, API = "https://github.com/%s/%s.git", "https://api.github.com/repos/%s/%s/zipball/%s", \
    "https://api.github.com/repos/%s/%s"
EMPTY = "URL cannot be empty"
BAD_SSH = "Invalid SSH GitHub URL format. Use: git@github.com:owner/repo.git"
BAD_SCHEME = "URL must start with https:// or http://"
BAD_HOST = "Only GitHub URLs are supported (github.com)"
NO_REPO = "Could not extract owner/repo from URL. Use: https://github.com/owner/repo"
BAD_OWNER, BAD_NAME = "Invalid repository owner: '%s'", "Invalid repository name: '%s'"

# scheme, authority and path of a URL; query and fragment are cut off
_PARTS = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"


def _host(url: Column) -> Column:
    authority = F.regexp_extract(url, _PARTS, 1)
    return F.lower(F.split_part(F.substring_index(authority, "@", -1), F.lit(":"), F.lit(1)))


def parse_repo_url(url: Column) -> Column:
    """``struct<owner, repo, branch>``; all null for other URLs."""
    trimmed = F.rtrim(strip(url), F.lit("/"))
    is_ssh = trimmed.rlike(SSH)
    web_path = F.regexp_replace(F.regexp_extract(trimmed, _PARTS, 2), ";[^/]*$", "")     # parameters
    parts = F.filter(F.split(web_path, "/"), lambda p: p != "")
    is_web = _host(trimmed).isin(HOSTS) & (F.size(parts) >= 2)
    branch = F.when((F.size(parts) >= 4) & (F.get(parts, 2) == "tree"), F.get(parts, 3))
    return F.struct(
        F.when(is_ssh, F.regexp_extract(trimmed, SSH, 1)).when(is_web, F.get(parts, 0)).alias("owner"),
        F.when(is_ssh, F.regexp_extract(trimmed, SSH, 2))
        .when(is_web, F.replace(F.get(parts, 1), F.lit(".git"), F.lit(""))).alias("repo"),
        F.when(~is_ssh & is_web, branch).alias("branch"))


def validate_repo_url(url: Column) -> Column:
    """``struct<valid, error>``."""
    trimmed, parsed = strip(url), parse_repo_url(url)
    owner, repo = parsed["owner"], parsed["repo"]
    web = trimmed.startswith("http://") | trimmed.startswith("https://")
    missing = (F.coalesce(owner, F.lit("")) == "") | (F.coalesce(repo, F.lit("")) == "")
    error = (
        F.when(F.coalesce(url, F.lit("")) == "", EMPTY)
        .when(trimmed.startswith("git@"), F.when(~trimmed.rlike(SSH_START), BAD_SSH).otherwise(""))
        .when(~web, BAD_SCHEME)
        .when(~_host(trimmed).isin(HOSTS), BAD_HOST)
        .when(missing, NO_REPO)
        .when(~owner.rlike(NAME), F.format_string(BAD_OWNER, owner))
        .when(~repo.rlike(NAME), F.format_string(BAD_NAME, repo))
        .otherwise(""))
    return F.struct((error == "").alias("valid"), error.alias("error"))


def clone_url(owner: Column, repo: Column) -> Column:
    return F.format_string(CLONE, owner, repo)


def zip_url(owner: Column, repo: Column, branch: Column | None = None) -> Column:
    return F.format_string(ZIP, owner, repo, F.coalesce(branch, F.lit("main")) if branch is not None else F.lit("main"))


def api_url(owner: Column, repo: Column) -> Column:
    return F.format_string(API, owner, repo)


def display_name(url: Column) -> Column:
    parsed = parse_repo_url(url)
    named = (F.coalesce(parsed["owner"], F.lit("")) != "") & (F.coalesce(parsed["repo"], F.lit("")) != "")
    return F.when(named, F.concat_ws("/", parsed["owner"], parsed["repo"])).otherwise(url)
