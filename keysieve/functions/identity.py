"""Column expressions on rules, URLs, times and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysieve.functions.text import any_of

# Hosts with a platform of their own.
PLATFORMS = {
    "github.com": "github", "gitlab.com": "gitlab", "codeberg.org": "codeberg",
    "bitbucket.org": "bitbucket",
}
# Rules whose secrets a provider can confirm.
VERIFIABLE_RULES = [
    "github-pat", "github-oauth", "github-app", "github-refresh", "gitlab-pat",
    "gitlab-pipeline", "gitlab-runner", "openai-api-key", "openai-project-key",
    "anthropic-api-key", "claude-3-api-key", "openrouter-api-key", "groq-api-key",
    "perplexity-api-key", "gcp-api-key", "gemini-api-key", "gemini-ultra-api-key",
    "slack-bot-token", "slack-user-token", "slack-app-token", "discord-bot-token",
    "aws-access-key-id", "gcp-service-account", "stripe-secret-key",
    "stripe-restricted-key", "huggingface-token", "replicate-token", "circleci-token",
    "travisci-token", "datadog-api-key", "newrelic-api-key", "twilio-account-sid",
    "firebase-api-key", "sendgrid-api-key", "mailgun-private-key", "azure-sas-token",
]
# Words in a rule id that set its severity.
HIGH_WORDS = ["private-key", "aws", "database", "jwt"]
MEDIUM_WORDS = ["api-key", "token", "secret"]


def specificity(rule_id: Column) -> Column:
    return F.when(rule_id.startswith("generic-"), 0).otherwise(F.length(rule_id))


def is_high(rule_id: Column) -> Column:
    return rule_id.rlike(any_of(HIGH_WORDS))


def is_medium(rule_id: Column) -> Column:
    return rule_id.rlike(any_of(MEDIUM_WORDS))


def category(rule_id: Column) -> Column:
    return F.substring_index(rule_id, "-", 1)


def target_type(target: Column, is_file: Column | None = None) -> Column:
    remote = target.startswith("http") | target.startswith("git@")
    local = F.lit("directory") if is_file is None else F.when(
        is_file, "file").otherwise("directory")
    return F.when(remote, "git_url").otherwise(local)


def is_git_url(target: Column) -> Column:
    return target.rlike(r"\A(?:https?://|git@|ssh://|git://)")


def repo_name(url: Column) -> Column:
    """The last path part of a URL, or what follows the colon of ``git@host:name``."""
    bare = F.regexp_replace(F.regexp_replace(url, r"/+\z", ""), r"\.git\z", "")
    after_colon = F.when(bare.contains(":") & ~F.substring_index(bare, ":", -1).contains("@"),
                         F.substring_index(bare, ":", -1))
    name = F.when(bare.contains("/"), F.substring_index(bare, "/", -1)).otherwise(after_colon)
    return F.when(name != "", name)


def platform(url: Column) -> Column:
    found = [F.when(url.contains(host), name) for host, name in PLATFORMS.items()]
    return F.coalesce(*found, F.lit("unknown"))


def owner(url: Column) -> Column:
    return F.regexp_extract(url, r"\A.*\.(?:com|org)/([^/]*)/", 1)


def project(url: Column) -> Column:
    return F.regexp_extract(url, r"\A.*\.(?:com|org)/[^/]*/([^/.]*)", 1)


def canonical_url(url: Column) -> Column:
    """The repository a link points into, with exactly one ``.git``."""
    page = F.when(url.contains("gitlab.com"), r"(?s)#.*|/-/.*").otherwise(
        r"(?s)#.*|/(?:issues|pull|blob|tree).*")
    return F.concat(F.regexp_replace(F.regexp_replace(url, page, F.lit("")), r"\.git\z", ""),
                    F.lit(".git"))


def url_host(target: Column) -> Column:
    """The host of a URL, null for anything else."""
    return F.when(target.contains("://"),
                  F.substring_index(F.get(F.split(target, "://"), F.lit(1)), "/", 1))


def known_host(path: Column) -> Column:
    """The public host a target path names."""
    return F.coalesce(*[
        F.when(path.contains(h), h) for h in ("github.com", "gitlab.com", "codeberg.org")])


def scan_id(ts: Column) -> Column:
    """32 hex digits of the microseconds since the epoch."""
    return F.lower(F.lpad(F.hex(F.unix_micros(ts)), 32, "0"))


def iso_utc(ts: Column) -> Column:
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def secret_hash(rule_id: Column, path: Column, line: Column, preview: Column) -> Column:
    """The identity of a finding in the queue."""
    return F.sha2(F.concat(rule_id, path, line.cast("string"), preview), 256)


def finding_status(verification_status: Column, verification: Column) -> Column:
    """The status of a report's finding, from either of the fields that hold one."""
    return (
        F.when(verification_status.isNotNull(),
               F.coalesce(verification_status["status"], F.lit("unknown")))
        .when(verification.isNotNull(), F.coalesce(verification["status"], F.lit("unknown")))
        .otherwise("not_verified")
    )


def verified_status(status: Column) -> Column:
    """active, inactive or unknown, however it was spelled."""
    return F.when(F.lower(status).isin("active", "inactive"), F.lower(status)).otherwise("unknown")


def is_verified(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin("active", "inactive"), F.lit(False))


def http_status(code: Column) -> Column:
    return (F.when(code.between(200, 299), "active")
            .when(code.isin(401, 403), "inactive").otherwise("unknown"))


def http_message(code: Column) -> Column:
    return (F.when(code.between(200, 299), "Secret is valid")
            .when(code.isin(401, 403), "Secret is invalid or revoked")
            .when(code == 429, "Rate limited")
            .otherwise(F.concat(F.lit("HTTP "), code.cast("string"))))


def has_verifier(rule_id: Column) -> Column:
    return rule_id.isin(VERIFIABLE_RULES)
