"""What a session or note file's path says about its origin."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.fixed_values import (
    EXCLUDED_NAME_GLOBS,
    PATH_SUFFIX_MARKERS,
    SESSION_UUID_PATTERN,
    SKIPPED_DIRECTORIES,
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]*\z", 1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+\z", "")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, NULL if none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def session_uuid(path: Column) -> Column:
    """The file's session UUID: the whole stem, else the last UUID in the name."""
    stem = F.element_at(F.split(file_stem(path), r"\."), 1)
    every = F.regexp_extract_all(file_name(path), F.lit(SESSION_UUID_PATTERN), F.lit(1))
    return F.when(stem.rlike(rf"\A{SESSION_UUID_PATTERN}\z"), stem).otherwise(
        F.when(F.size(every) > 0, F.element_at(every, -1))
    )


def glob_to_regex(glob: str) -> str:
    """An anchored pattern for a file-name glob."""
    out, rest = [], glob
    while rest:
        bracket = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if rest[0] == "*":
            out.append(".*")
        elif rest[0] == "?":
            out.append(".")
        elif bracket:
            members = bracket[2].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
            out.append(f"[{'^' if bracket[1] else ''}{members}]")
            rest = rest[bracket.end() :]
            continue
        else:
            out.append(re.escape(rest[0]))
        rest = rest[1:]
    return r"(?s)\A" + "".join(out) + r"\z"


def load_globs(lines: Iterable[str]) -> list[str]:
    """Globs of an exclusion file; blank lines and comments are skipped."""
    return [s for s in (line.strip() for line in lines) if s and not s.startswith("#")]


def is_excluded(path: Column, globs: Iterable[str] = EXCLUDED_NAME_GLOBS) -> Column:
    name = file_name(path)
    tests = [name.rlike(glob_to_regex(g)) for g in globs]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_session_file(path: Column) -> Column:
    return F.endswith(path, F.lit(".jsonl")) & ~F.contains(path, F.lit("/subagents/"))


def in_skipped_directory(path: Column) -> Column:
    return F.arrays_overlap(
        F.split(path, "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRECTORIES])
    )


def note_agent(path: Column) -> Column:
    """Agent owning a note file, from its workspace folder."""
    named = F.regexp_extract(path, r"(?U)/clawd-(\w+)/", 1)
    return (
        F.when(
            F.contains(path, F.lit("/clawd-")),
            F.when(named != "", named).otherwise("unknown"),
        )
        .when(F.contains(path, F.lit("/clawd/")), "main")
        .when(F.contains(path, F.lit("/shared/")), "shared")
        .otherwise("unknown")
    )


def path_suffix(path: Column) -> Column:
    """The part of a remote path that agent detection needs."""
    cuts = [
        F.when(F.instr(path, m) > 0, F.substr(path, F.instr(path, m)))
        for m in PATH_SUFFIX_MARKERS
    ]
    return F.coalesce(*cuts, file_name(path))


@dataclass(frozen=True)
class Naming:
    """Agent names in use: slot id (lower case) to display name, and home folders."""

    aliases: Mapping[str, str] = field(default_factory=dict)
    local_home: str = "/root"
    remote_home: str = ""

    def display(self, name: str) -> str:
        return self.aliases.get(name.lower(), name)

    def display_column(self, name: Column) -> Column:
        """Display name of a slot id held in a column; unknown ids pass through."""
        if not self.aliases:
            return name
        pairs = [F.lit(x) for item in self.aliases.items() for x in item]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(name)), name)

    def is_known(self, name: Column) -> Column:
        return F.lower(name).isin(list(self.aliases)) if self.aliases else F.lit(False)

    def looks_hex(self, name: Column) -> Column:
        return name.rlike(r"\A[0-9a-fA-F]{6,}\z") & ~self.is_known(name)


def with_session_metadata(
    files: DataFrame, naming: Naming = Naming(), telegram: str | None = None
) -> DataFrame:
    """Files (`path`) with agent_id, channel and channel_id read from the path.

    The folder decides first, then the file name, then a UUID-shaped name. The
    column `telegram` marks files listed in their folder's telegram list. Stages
    are columns of their own, so each is computed once.
    """
    path, unknown = F.col("path"), F.lit("unknown")
    main_name, claude_name = naming.display("main"), naming.display("claude")
    terminal = F.lit("terminal")
    if telegram is not None:
        terminal = F.when(F.coalesce(telegram, F.lit(False)), "telegram").otherwise("terminal")

    def holds(part: str) -> Column:
        return F.contains(path, F.lit(part))

    def renamed(name: Column, slot: Column, on_remote: str) -> Column:
        """Display name of a slot; the main slot of a remote machine differs."""
        return F.when(F.col("_remote") & (slot == "main"), on_remote).otherwise(
            naming.display_column(name)
        )

    slot, archived = F.col("_slot"), F.col("_archived")
    claude_project = F.when(holds(naming.local_home), naming.display("cc-vps")).otherwise(
        naming.display("claude-code")
    )
    folder_rules = [
        (slot.isNotNull(), renamed(slot, slot, "Claude"), F.lit("direct")),
        (holds("/agents-archive-cc/"), F.lit(naming.display("claude-code")), F.lit("terminal")),
        (holds("/agents-archive-claude/"), F.lit(claude_name), F.lit("direct")),
        (holds("/agents-archive-vps/"), F.lit(main_name), F.lit("direct")),
        (archived.isNotNull(), naming.display_column(archived), F.lit("direct")),
        (holds("/agents-grok-sessions/"), F.lit("grok"), F.lit("direct")),
        (holds("/agents-chat-sessions/"), F.lit("chat"), F.lit("direct")),
        (holds(".claude/projects"), claude_project, terminal),
    ]

    def first_rule(outcome: int) -> Column:
        test, *_ = folder_rules[0]
        chain = F.when(test, folder_rules[0][outcome])
        for rule in folder_rules[1:]:
            chain = chain.when(rule[0], rule[outcome])
        return chain.otherwise(unknown)

    name_without_suffix = F.replace(
        F.regexp_replace(file_name(path), r"\.deleted\.\S+\z", ""), F.lit(".jsonl"), F.lit("")
    )
    parts = F.col("_parts")
    first, second, third, fourth = (F.get(parts, F.lit(i)) for i in range(4))
    named = (first == "agent") & (F.size(parts) >= 2)
    routed = named & (F.size(parts) >= 5) & third.isin("discord", "slack", "telegram")
    beyond_third = F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0)))
    overrides = (
        named
        & F.col("_agent").isin("unknown", main_name, claude_name)
        & naming.is_known(second)
    )
    bare = F.regexp_replace(file_stem(path), r"urn:|uuid:|[{}-]", "")
    is_uuid = (F.col("_agent") == unknown) & bare.rlike(r"\A[0-9a-fA-F]{32}\z")
    parent = parent_name(path)
    by_first_part = (
        F.when(naming.is_known(first), renamed(first, F.lower(first), claude_name))
        .when(naming.looks_hex(first) & naming.is_known(parent), naming.display_column(parent))
        .otherwise(unknown)
    )
    remote = holds(naming.remote_home) if naming.remote_home else F.lit(False)
    return (
        files.withColumns(
            {
                "_remote": remote,
                "_slot": _found(path, r"/agents/([^/]+)/sessions/"),
                "_archived": _found(path, r"/agents-archive/([^/]+)/"),
                "_parts": F.split(name_without_suffix, "-"),
            }
        )
        .withColumns({"_agent": first_rule(1), "_channel": first_rule(2)})
        .withColumns(
            {
                "_agent": F.when(overrides, renamed(second, second, claude_name)).otherwise(F.col("_agent")),
                "_channel": F.when(named & (F.size(parts) >= 3), third).otherwise(F.col("_channel")),
                "channel_id": F.when(
                    routed,
                    F.when(third == "discord", F.array_join(beyond_third, "-")).otherwise(fourth),
                ),
            }
        )
        .withColumns(
            {
                "_agent": F.when(is_uuid, naming.display("claude-code")).otherwise(F.col("_agent")),
                "channel": F.when(is_uuid, "terminal").otherwise(F.col("_channel")),
            }
        )
        .withColumn("_agent", F.when(F.col("_agent") == unknown, by_first_part).otherwise(F.col("_agent")))
        .withColumn(
            "agent_id", F.when(naming.looks_hex(F.col("_agent")), unknown).otherwise(F.col("_agent"))
        )
        .drop("_remote", "_slot", "_archived", "_parts", "_agent", "_channel")
    )
