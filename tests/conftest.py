import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from importflow.session import STATE_STORE, local_session

    session = local_session(
        "8", 4,
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        },
    )
    yield session
    session.stop()


@pytest.fixture
def uploads(tmp_path):
    """Write source files under <org>/<upload>/source.csv; returns (put, glob)."""

    class Uploads:
        pattern = f"{tmp_path}/*/*/source.csv"

        def put(self, upload: str, content: str | bytes, org: str = "org") -> str:
            folder = tmp_path / org / upload
            folder.mkdir(parents=True, exist_ok=True)
            data = content.encode() if isinstance(content, str) else content
            (folder / "source.csv").write_bytes(data)
            return f"{org}/{upload}/source.csv"

    return Uploads()
