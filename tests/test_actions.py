import datetime as dt
import os

from veilspark.streaming import actions
from veilspark.streaming.actions import Player, RecordingClient

SCHEMA = "k long, at timestamp, action string, scene string"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def write(spark, path, rows):
    spark.createDataFrame([(k, at(t), a, s) for k, t, a, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


ROWS = [(1, 0, "privacy", "cover"), (1, 5, "return", "desk"), (1, 5, "privacy", "cover"), (2, 3, "privacy", "cover"), (1, 9, "return", "desk")]


def streamed(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_actions_are_played_once_and_in_order(spark, tmp_path):
    source, out, seen = (str(tmp_path / n) for n in ("in", "out", "seen"))
    write(spark, source, ROWS[:3])
    write(spark, source, ROWS[3:])
    make = lambda: RecordingClient(seen)
    got = actions.play(streamed(spark, source), "k", make, out, str(tmp_path / "state"), wait=0)
    assert got.where("played").count() == 5 and got.where("attempts <> 1 OR problem IS NOT NULL").count() == 0
    told = [a["token"] for a in RecordingClient(seen).played()]
    assert len(told) == 5
    own = [t.split("|")[1:] for t in told if t.startswith("1|")]
    assert [(t[0][17:19], t[1]) for t in own] == [("00", "privacy"), ("05", "return"), ("05", "privacy"), ("09", "return")]
    # the stream forgets what it did: batches that are over are not played, one that broke off sends its tokens again
    again = actions.play(streamed(spark, source), "k", make, out, str(tmp_path / "state2"), wait=0)
    assert again.count() == 5 and len(RecordingClient(seen).played()) == 5
    os.remove(f"{out}/played/batch=0/_SUCCESS")
    last = actions.play(streamed(spark, source), "k", make, out, str(tmp_path / "state3"), wait=0)
    assert last.count() == 5 and len(RecordingClient(seen).played()) == 5


def test_an_unknown_scene_fails_alone(spark, tmp_path):
    write(spark, str(tmp_path / "in"), ROWS)
    seen = str(tmp_path / "seen")
    got = actions.play(streamed(spark, str(tmp_path / "in")), "k", lambda: RecordingClient(seen, ["cover"]), str(tmp_path / "out"), str(tmp_path / "state"), wait=0).collect()
    assert {(r.scene, r.played) for r in got} == {("cover", True), ("desk", False)}
    assert {r.problem for r in got if not r.played} == {"there is no scene 'desk'"}


class Unsteady:
    """Fails at the calls whose numbers it is given."""

    def __init__(self, bad, calls):
        self.bad, self.calls = bad, calls

    def _call(self, what):
        self.calls.append(what)
        if len(self.calls) in self.bad:
            raise ConnectionError("gone")

    def connect(self):
        self._call("connect")

    def scenes(self):
        return None

    def show(self, scene, token):
        self._call(f"show {scene}")


def test_a_lost_client_is_connected_again():
    calls = []
    player = Player(lambda: Unsteady({2, 3}, calls), 3, 0)
    assert player.play("a", "t1") == (True, 3, None)
    assert player.play("b", "t2") == (True, 1, None)
    assert calls == ["connect", "show a", "connect", "connect", "show a", "show b"]
    calls.clear()
    assert Player(lambda: Unsteady({1, 2}, calls), 2, 0).play("a", "t") == (False, 2, "gone")


def test_a_token_is_played_once(tmp_path):
    client = RecordingClient(str(tmp_path / "c"))
    client.connect()
    client.show("a", "t")
    client.show("a", "t")
    client.show("a", "u")
    assert [c["token"] for c in client.played()] == ["t", "u"] and actions.SilentClient().scenes() is None
