import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vigilframe.session import build_session  # noqa: E402

SECOND = 1_000_000


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"

KINDS = {
    "enter": ("question_view", "enter", None),
    "leave": ("question_view", "leave", None),
    "answer": ("question_answer", None, None),
    "paste": ("clipboard", "paste", None),
    "copy": ("clipboard", "copy", None),
    "hidden": ("visibility_change", None, "hidden"),
    "visible": ("visibility_change", None, "visible"),
    "idle": ("idle_state", None, "idle"),
    "active": ("idle_state", None, "active"),
    "submit": ("exam_submitted", None, None),
    "blur": ("blur", None, "blurred"),
    "focus": ("focus", None, "focused"),
    "other": ("scroll", None, None),
}


@pytest.fixture
def attempts(spark):
    """Canonical events from {attempt: [(kind, second[, question[, seq]]), ...]}; list order is arrival."""

    def make(spec: dict):
        rows = []
        for attempt, events in spec.items():
            for pos, event in enumerate(events):
                kind, at, question, seq = (*event, "q1", 0)[:4] if len(event) == 2 else (*event, 0)[:4]
                event_type, action, state = KINDS[kind]
                rows.append((attempt, event_type, action, state, question, int(at * SECOND), seq, pos, pos * SECOND))
        return spark.createDataFrame(
            rows,
            "attempt_id string, event_type string, action string, state string, question_id string, "
            "t_us long, client_seq long, arrival long, received_us long",
        )

    return make


def same(a, b) -> bool:
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
