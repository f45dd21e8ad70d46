"""The training-data operators in a session that names no checkpoint folder."""

from tests.test_scratch import run_without_checkpoint_folder


def test_operators_run_without_a_checkpoint_folder(tmp_path):
    *rows, scratch = run_without_checkpoint_folder(tmp_path, "op1_chat_format", "op8_secret_scans")
    assert [x[0] for x in rows] == ["op1_chat_format", "op8_secret_scans"] and all(int(x[1]) > 0 for x in rows)
    assert scratch == ["True"] and not list(tmp_path.glob("oddsmill-*"))
