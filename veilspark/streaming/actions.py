"""Playing scene switches: an idempotent sink per micro-batch, with retry, and a recording client."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SceneClient(Protocol):
    """What a task needs of a scene-switching program. Each call may raise ``ConnectionError``.

    A token names one action for good: a client that has played it does
    nothing, so that an action that is sent again is played once.
    """

    def connect(self) -> None: ...

    def scenes(self) -> list[str] | None:
        """The scenes there are; None if every name will do."""

    def show(self, scene: str, token: str) -> None: ...


class RecordingClient:
    """Test double: a file for each action, named by its token, in a folder that all workers share."""

    def __init__(self, folder: str, known: list[str] | None = None):
        self.folder, self.known = folder, known

    def connect(self) -> None:
        os.makedirs(self.folder, exist_ok=True)

    def scenes(self) -> list[str] | None:
        return self.known

    def show(self, scene: str, token: str) -> None:
        try:
            with open(f"{self.folder}/{hashlib.sha256(token.encode()).hexdigest()}.json", "x", encoding="utf-8") as f:
                json.dump({"scene": scene, "token": token, "ns": time.time_ns()}, f)
        except FileExistsError:
            pass

    def played(self) -> list[dict]:
        """All actions in the order in which they were played."""
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return sorted((json.load(open(f"{self.folder}/{n}", encoding="utf-8")) for n in names), key=lambda a: a["ns"])


class SilentClient:
    """Takes every action and does nothing."""

    def connect(self) -> None:
        pass

    def scenes(self) -> list[str] | None:
        return None

    def show(self, scene: str, token: str) -> None:
        pass


class Player:
    """A client that is connected when it is needed, and again after each failure."""

    def __init__(self, make: Callable[[], SceneClient], attempts: int, wait: float):
        self.make, self.attempts, self.wait = make, attempts, wait
        self.client: SceneClient | None = None
        self.known: list[str] | None = None

    def play(self, scene: str, token: str) -> tuple[bool, int, str | None]:
        """Whether the action was played, after how many attempts, and what was wrong last."""
        problem = None
        for attempt in range(1, self.attempts + 1):
            try:
                if self.client is None:
                    client = self.make()
                    client.connect()
                    self.client, self.known = client, client.scenes()
                if self.known is not None and scene not in self.known:
                    return False, attempt, f"there is no scene {scene!r}"
                self.client.show(scene, token)
            except ConnectionError as e:
                self.client, problem = None, str(e) or type(e).__name__
                if attempt < self.attempts:
                    time.sleep(self.wait)
            else:
                return True, attempt, None
        return False, self.attempts, problem


_RESULT = T.StructType([T.StructField("played", T.BooleanType()), T.StructField("attempts", T.IntegerType()), T.StructField("problem", T.StringType())])


def _tasks(make: Callable[[], SceneClient], attempts: int, wait: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player = Player(make, attempts, wait)
        for pdf in batches:
            results = [player.play(s, t) for s, t in zip(pdf["scene"], pdf["token"], strict=True)]
            out = pdf.drop(columns=["token"])
            for k, name in enumerate(_RESULT.names):
                out[name] = pd.Series([r[k] for r in results], index=pdf.index, dtype="object")
            yield out

    return run


def play(actions: DataFrame, key: str, make: Callable[[], SceneClient], path: str, checkpoint: str, *, attempts: int = 3, wait: float = 5.0) -> DataFrame:
    """Plays a stream of actions (key, at, action, scene) over what there is; returns (key, at, action, scene, played, attempts, problem).

    The actions of a micro-batch are saved under its number and then played by
    tasks, those of one key in order of time by one task. What became of them is
    a table too; a batch that has one is over and is not played when Spark runs
    it again. A batch or task that broke off in the middle sends its actions
    again, with the tokens they had. A scene that the client does not have, or
    a client that cannot be reached in ``attempts``, ``wait`` seconds apart,
    fails the action and no other.
    """
    spark = actions.sparkSession
    columns = actions.select(key, "at", "action", "scene").schema
    result = T.StructType([*columns.fields, *_RESULT.fields])
    tables = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    over = lambda folder: tables.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS"))

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        plan, done = f"{path}/plan/batch={number}", f"{path}/played/batch={number}"
        if over(done):
            return
        if not over(plan):
            batch.select(*columns.names).write.mode("overwrite").parquet(plan)
        told = session.read.schema(columns).parquet(plan)
        # a hold that ends when the next begins goes back before it is covered again
        turn = F.when(F.col("action") == "return", 0).otherwise(1)
        token = F.concat_ws("|", F.col(key).cast("string"), F.col("at").cast("string"), "action", "scene")
        ordered = told.withColumn("token", token).repartition(key).sortWithinPartitions(key, "at", turn, "scene")
        ordered.mapInPandas(_tasks(make, attempts, wait), result).write.mode("overwrite").parquet(done)

    spark.createDataFrame([], result).write.mode("overwrite").parquet(f"{path}/played/batch=-1")
    actions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result).parquet(f"{path}/played").select(*result.names)
