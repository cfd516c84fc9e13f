"""Rules over tool calls: what a call did, its task, and how surely its result came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Arguments that tell a call best, in order, and the characters kept of one.
ARGUMENT_KEYS = ["command", "file_path", "target_file", "target_directory", "prompt"]
SUMMARY = 50

# Tasks by words in the tool's name or arguments, the first that fits.
TASKS = {
    "code-edit": ["replace", "edit", "write"],
    "testing": ["test"],
    "build": ["build", "cargo", "compile"],
    "vcs": ["git", "commit", "push"],
    "deploy": ["deploy", "docker"],
    "search": ["search", "grep", "find"],
}

# Words in a result that speak of an action.
ACTION_WORDS = {
    "write": ["written", "created", "has been written", "file "],
    "search_replace": ["updated", "has been updated", "replaced"],
    "run_terminal_command": ["exit:", "stdout", "stderr"],
    "spawn_subagent": ["subagent", "completed", "returned"],
}

# Tools whose calls are decisions, tools that read, marks of any failure, and marks of a clear one.
STATE_CHANGING = ["write", "search_replace", "image_gen", "image_edit", "spawn_subagent", "scheduler_create", "scheduler_delete", "Write", "Edit", "NotebookEdit"]
READ_ONLY = ["run_terminal_command", "Bash", "exec", "exec_command", "read", "Read", "WebSearch", "WebFetch", "update_goal", "update_plan", "kill_command_or_subagent", "list_dir", "List", "search_tool", "use_tool"]
FAILURES = ["error", "Error", "ERROR", "failed", "Failed", "FAILED", "panic", "Panic", "traceback", "Traceback", "exception", "Exception", "denied", "not found", "No such file", "fatal", "FATAL", "exit: 1", "exit code: 1", "exit code 1", "cannot find", "cannot resolve", "unresolved", "timeout", "timed out", "conflict", "CONFLICT"]
CLEAR_FAILURES = ["error[", "error:", "Error:", "ERROR:", "panic:", "thread 'main' panicked", "Traceback (most recent call last)", "exit: 1", "exit code: 1", "Process exited with non-zero", "test failed", "tests failed", "FAILED ", "command not found", "Permission denied", "fatal:", "compilation failed", "could not compile"]

# Outcomes of events that are failures, and the grades (confidence, source) of a result.
FAILED_EVENTS = ["error", "failure", "timeout"]
GRADES = {
    "failure, related": (0.8, "rule"),
    "failure": (0.65, "rule"),
    "success, related": (0.55, "llm_inferred"),
    "success": (0.4, "temporal"),
    "related": (0.5, "llm_inferred"),
    "none": (0.3, "temporal"),
}


def has_any(text: Column, words: list[str]) -> Column:
    """The text contains one of the words as written; false for null."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return F.coalesce(found, F.lit(False))


def clear_failure(content: Column) -> Column:
    """A clear mark of failure within the first 5 lines of the first 200 characters."""
    return has_any(F.substring_index(F.substring(content, 1, 200), "\n", 5), CLEAR_FAILURES)


def worthy(tool: Column, content: Column) -> Column:
    """Calls to keep: of tools that read only where they clearly failed, of tools that change state all, of others none."""
    return F.when(has_any(tool, READ_ONLY), clear_failure(content)).otherwise(has_any(tool, STATE_CHANGING))


def summarise(arguments: Column) -> Column:
    """The argument that tells most, else the first by name, else the text as it is; cut after 50 characters."""
    held = F.from_json(arguments, "map<string,string>")
    named = F.filter(F.array(*[F.lit(k) for k in ARGUMENT_KEYS]), lambda k: F.map_contains_key(held, k))
    key = F.try_element_at(F.concat(named, F.array_sort(F.map_keys(held))), F.lit(1))
    text = F.when(key.isNotNull(), F.coalesce(F.try_element_at(held, key), F.lit("null"))).otherwise(arguments)
    return F.when(F.char_length(text) > SUMMARY, F.concat(F.substring(text, 1, SUMMARY), F.lit("..."))).otherwise(text)


def decision(tool: Column, arguments: Column) -> Column:
    return F.concat(tool, F.lit("("), F.coalesce(summarise(arguments), F.lit("")), F.lit(")"))


def task_tag(tool: Column, arguments: Column) -> Column:
    text = F.lower(F.concat_ws(" ", tool, arguments))
    tag = F
    for name, words in TASKS.items():
        tag = tag.when(has_any(text, words), F.lit(name))
    return tag.otherwise(F.lit("general"))


def relates(decision: Column, result: Column) -> Column:
    """The result names something of 4 bytes or more from the call's arguments, or speaks of such an action."""
    low, said = F.lower(decision), F.lower(result)
    arguments = F.split(F.regexp_extract(low, r"(?s)\((.*)\)", 1), r"[^\p{L}\p{N}_.-]+")
    named = F.exists(arguments, lambda t: (F.octet_length(t) >= 4) & F.contains(said, t))
    for action, words in ACTION_WORDS.items():
        named = named | (F.contains(low, F.lit(action)) & has_any(said, words))
    return F.coalesce(named, F.lit(False))


def grade(decision: Column, result: Column, event: Column) -> tuple[Column, Column]:
    """(confidence, source) that the result came of the decision; event: the outcome that the log gives, or null."""
    return _graded(_case(decision, result, event))


def _case(decision: Column, result: Column, event: Column) -> Column:
    """The name among GRADES that fits."""
    failed = F.coalesce(event.isin(FAILED_EVENTS), F.lit(False)) | has_any(result, FAILURES)
    done, related = F.coalesce(event == "success", F.lit(False)), relates(decision, result)
    return F.when(related, F.when(failed, "failure, related").when(done, "success, related").otherwise("related")).when(failed, "failure").when(done, "success").otherwise("none")


def _graded(case: Column) -> tuple[Column, Column]:
    def pick(i: int) -> Column:
        out = F
        for name, grade in GRADES.items():
            out = out.when(case == name, F.lit(grade[i]))
        return out

    return pick(0), pick(1)


def with_grade(rows: DataFrame, decision: Column, result: Column, event: Column) -> DataFrame:
    """rows with decision, confidence and source, as grade says. The decision and what it says of the result are worked out once a row, in columns of their own."""
    cased = rows.withColumn("decision", decision).withColumn("_case", _case(F.col("decision"), result, event))
    confidence, source = _graded(F.col("_case"))
    return cased.withColumns({"confidence": confidence, "source": source}).drop("_case")
