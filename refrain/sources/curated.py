"""Curated developer-style messages (our own rows).

The generated tables are invented prose, so rules, keywords and catalogues
match almost nothing in them. These rows are unioned with the tables so every
rule, category, tie and edge case is exercised while the work still grows with
the tables. The same rows feed the Spark side and the DuckDB ``VALUES`` list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (uuid, session_id, project_path, ts, text); ord is the position below, negated
# so the curated rows sort before any document.
ROWS = [
    ("k01", "sa", "/work/api", "2024-01-20 09:00:00", "This project uses FastAPI and Postgres, please keep that in mind"),
    ("k02", "sa", "/work/api", "2024-01-21 09:00:00", "this project uses fastapi and postgres, keep that in mind please"),
    ("k03", "sb", "/work/api", "2024-01-22 09:00:00", "This project uses FastAPI and Postgres, please keep it in mind"),
    ("k04", "sb", "/work/api", "2024-01-23 09:00:00", "We use ruff for lint and black for formatting in this repo"),
    ("k05", "sc", "/work/web", "2024-01-24 09:00:00", "Do it the same way as before with the table layout"),
    ("k06", "sc", "/work/web", "2024-01-25 09:00:00", "Format the output like you did last time for the report"),
    ("k07", "sc", "/work/web", "2024-01-26 09:00:00", "Upgrade to Python 3.12 and Node v20 for the build image"),
    ("k08", "sd", "/work/web", "2024-01-27 09:00:00", "We are on React 18 and Next.js 14 for the frontend app"),
    ("k09", "sd", "/work/auth", "2024-01-28 09:00:00", "Refresh the JWT when the session cookie expires"),
    ("k10", "sd", "/work/auth", "2024-01-29 09:00:00", "Add OAuth login and keep the API key out of the logs"),
    ("k11", "se", "/work/auth", "2024-01-30 09:00:00", "Use pytest for the new module tests, no other runner"),
    ("k12", "se", "/work/ops", "2024-01-31 09:00:00", "Run lint then run the tests then commit and push the branch"),
    ("k13", "se", "/work/ops", "2024-02-01 09:00:00", "run lint then run the tests then commit and push the branch"),
    ("k14", "sf", "/work/ops", "2024-02-02 09:00:00", "Run lint, then run the tests, then commit and push the branch"),
    ("k15", "sf", "/work/ops", "2024-02-03 09:00:00", "Run lint then run the tests then commit and push this branch"),
    ("k16", "sf", "/work/gen", "2024-02-04 09:00:00", "Generate a dockerfile and scaffold a starter template for the service"),
    ("k17", "sg", "/work/gen", "2024-02-05 09:00:00", "generate a dockerfile and scaffold a starter template for the service"),
    ("k18", "sg", "/work/gen", "2024-02-06 09:00:00", "Generate a Dockerfile and scaffold a starter template for this service"),
    ("k19", "sg", "/work/gen", "2024-02-07 09:00:00", "Explain why this test is failing on the second assertion"),
    ("k20", "sh", "/work/gen", "2024-02-08 09:00:00", "Explain why this test is failing on the second assertion"),
    ("k21", "sh", "/work/gen", "2024-02-09 09:00:00", "explain why this test is failing on the second assertion!"),
    ("k22", "sh", "/work/misc", "2024-02-10 09:00:00", "Create the release notes"),
    ("k23", "si", "/work/misc", "2024-02-11 09:00:00", "Base directory for this skill: /work/misc/.skills/x"),
    ("k24", "si", "/work/misc", "2024-02-12 09:00:00", "[Request interrupted by user for tool use]"),
    ("k25", "si", "/work/misc", "2024-02-13 09:00:00", "<local-command-stdout>done</local-command-stdout>"),
    ("k26", "sj", "/work/misc", "2024-02-14 09:00:00", "<task-notification>job finished with status ok</task-notification>"),
    ("k27", "sj", "/work/misc", "2024-02-15 09:00:00", "This session is being continued from a previous conversation"),
    ("k28", "sj", "/work/misc", "2024-02-16 09:00:00", "Conversation so far: we talked about the cache layer"),
    ("k29", "sk", "/work/misc", "2024-02-17 09:00:00", "hello world"),
    ("k30", "sk", "/work/misc", "2024-02-18 09:00:00", "hello world!"),
    ("k31", "sk", "/work/misc", "2024-02-19 09:00:00", "fix the flaky unit test"),
    ("k32", "sl", "/work/misc", "2024-02-20 09:00:00", "fix the flaky unit tests"),
    ("k33", "sl", "/work/misc", "2024-02-21 09:00:00", "Deploy the build to staging\nthen tag the release\nand notify the team"),
    ("k34", "sl", "/work/misc", "2024-02-22 09:00:00",
     "Please review the whole migration plan for the billing service, including the rollback steps, "
     "the data backfill and the dashboards we need before switching traffic over"),
    ("k35", "sm", "/work/misc", "2024-02-23 09:00:00", "? ! . , ; : - a b c d e f g h i"),
    ("k36", "sm", "/work/misc", "2024-02-24 09:00:00", "= + * / a b c d e f g h i j k l"),
    ("k37", "sm", "/work/misc", "2024-02-25 09:00:00", "Setup the workflow then deploy after that"),
    ("k38", "sn", "/work/api/v2", "2024-02-26 09:00:00", "Our stack is Django with a React frontend, tech stack is fixed"),
    ("k39", "sn", "/work/apiv2", "2024-02-27 09:00:00", "Initialize the repo and then build it"),
    ("k40", "sn", "/work/api", "2024-02-28 09:00:00", "Run lint then run the tests then commit and push the branch"),
]

SCHEMA = "uuid string, session_id string, project_path string, ts timestamp, text string, parent_uuid string, ord bigint"


def ord_of(i: int) -> int:
    return i - len(ROWS) - 1


def curated_messages(spark: SparkSession) -> DataFrame:
    import datetime as dt

    rows = [
        (u, s, p, dt.datetime.fromisoformat(t), x, None, ord_of(i))
        for i, (u, s, p, t, x) in enumerate(ROWS)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def curated_sql() -> str:
    from refrain.plans.oracle import q

    vals = ",\n".join(
        f"({q(u)}, {q(s)}, {q(p)}, TIMESTAMP {q(t)}, {q(x)}, CAST(NULL AS VARCHAR), CAST({ord_of(i)} AS BIGINT))"
        for i, (u, s, p, t, x) in enumerate(ROWS)
    )
    return f"SELECT * FROM (VALUES {vals}) AS t(uuid, session_id, project_path, ts, text, parent_uuid, ord)"


# Our own project listing (project_path, rel_path) for the recommendation tables.
INVENTORY = [
    ("/work/api", "CLAUDE.md"),
    ("/work/api", ".claude/skills/run-lint-then-run-the-tests-then-commit-and-push-t/SKILL.md"),
    ("/work/api", ".claude/notes.md"),
    ("/work/ops", ".claude/skills/deploy/SKILL.md"),
    ("/work/web", "README.md"),
    ("/home/dev/src1", "CLAUDE.md"),
    ("/home/dev/src10", ".claude/settings.md"),
]


def inventory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INVENTORY, "project_path string, rel_path string")


def inventory_sql() -> str:
    from refrain.plans.oracle import q

    vals = ", ".join(f"({q(p)}, {q(r)})" for p, r in INVENTORY)
    return f"SELECT * FROM (VALUES {vals}) AS t(project_path, rel_path)"


# Our own model replies for the response-merging operators (valid, invalid, fenced, unknown IDs).
RESPONSES = [
    ("cat:pat-001", "category", "repeatable-workflow"),
    ("cat:pat-002", "category", "  Boilerplate-Request "),
    ("cat:pat-003", "category", "not-a-category"),
    ("cat:pat-004", "category", ""),
    ("cat:pat-006", "category", "Context-re-explanation"),
    ("cat:pat-008", "category", "unsure"),
    ("m1", "match", '```json\n["ship-it", "nope", "notes"]\n```'),
    ("m2", "match", '["explain-failure", "gke-ops", "ship-it", "containerise", "notes", "auth-check", "stack-notes"]'),
    ("m3", "match", "sorry, no idea"),
]


def responses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESPONSES, "request_id string, kind string, reply string")


def responses_sql() -> str:
    from refrain.plans.oracle import q

    vals = ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in RESPONSES)
    return f"SELECT * FROM (VALUES {vals}) AS t(request_id, kind, reply)"


# Our own label replies (J11): one per pattern ID, a blank one is ignored.
LABELS = [("pat-001", "Recurring prose about the same topic"), ("pat-003", "   "), ("pat-099", "No such pattern")]


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "id string, label string")


def labels_sql() -> str:
    from refrain.plans.oracle import q

    vals = ", ".join(f"({q(a)}, {q(b)})" for a, b in LABELS)
    return f"SELECT * FROM (VALUES {vals}) AS t(id, label)"
