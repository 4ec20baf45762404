"""Row filters, as boolean column expressions that are never null."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CHAT_SOURCES, strip

# Providers that chats and orphans come from, and enumerations and least values of the turn contract.
CHAT_PROVIDERS = ("meta", "xai", "copilot", "google", "anthropic", "openai", "perplexity", "deepseek", "grok", "mistral")
ORPHAN_PROVIDERS = ("meta", "xai", "copilot", "google")
FIXTURE_PREFIXES = ("e2e-", "test-")


def never_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def has_text(text: Column) -> Column:
    return never_null(text != "")


def not_chitchat(text: Column, least: int = 50) -> Column:
    return never_null(F.length(text) >= least)


def not_fixture_session(session_id: Column) -> Column:
    return never_null(~session_id.startswith(FIXTURE_PREFIXES[0]) & ~session_id.startswith(FIXTURE_PREFIXES[1]))


def search_like(text: Column, query: str) -> Column:
    """Contains the query, whatever its case; % and _ in it are wildcards. An empty query matches nothing."""
    if not query.strip():
        return F.lit(False)
    return never_null(text.ilike("%" + query.strip().replace("\\", "\\\\") + "%"))


def is_chat_source(source: Column) -> Column:
    return never_null(source.isin(*CHAT_SOURCES))


def is_coding_source(source: Column) -> Column:
    return ~is_chat_source(source)


def coding_session_filter(chat_session: Column, source: Column, provider: Column) -> Column:
    """Without a chat session, and from a coding tool: by its source, or having none and no chat's provider."""
    unnamed = source.isNull() & ~never_null(provider.isin(*CHAT_PROVIDERS))
    return chat_session.isNull() & (never_null(source.isin("coding", "harness")) | unnamed)


def orphan_chat_filter(chat_session: Column, source: Column, provider: Column) -> Column:
    """Without a chat session, though from a chat: by its source, or having none and such a provider."""
    unnamed = source.isNull() & never_null(provider.isin(*ORPHAN_PROVIDERS))
    return chat_session.isNull() & (is_chat_source(source) | unnamed)


def draft_usable(draft: Column, least: int = 10) -> Column:
    return never_null(F.length(strip(draft)) >= least)


def opted_in(state: Column) -> Column:
    return never_null(state == "opted_in")


def pending_embed(completed: Column, attempts: Column, most: int = 3) -> Column:
    return completed.isNull() & (F.coalesce(attempts, F.lit(0)) < most)


def glob_to_regex(rule: str) -> str | None:
    """Regular expression of an ignore rule over whole relative paths; null for a comment or a blank line."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    anchored = "/" in rule.rstrip("/")
    folder, rule = rule.endswith("/"), rule.strip("/")

    def parts() -> Iterator[str]:
        at = 0
        while at < len(rule):
            if rule.startswith("**/", at):
                yield "(?:.*/)?"
                at += 3
            elif rule.startswith("**", at):
                yield ".*"
                at += 2
            else:
                yield {"*": "[^/]*", "?": "[^/]"}.get(rule[at]) or ("\\" + rule[at] if not rule[at].isalnum() and rule[at] not in "/_" else rule[at])
                at += 1

    return ("^" if anchored else "(?:^|/)") + "".join(parts()) + ("/" if folder else "(?:/|$)")
