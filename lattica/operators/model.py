"""Model calls over requests, with a client that is passed in. Partitions are the workers; answers keep their keys."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import text

Client = Callable[[str, bytes | None], str]

#: Wording of the three passes.
PROMPTS = {
    "global": "Describe the whole diagram: its purpose, its zones, and how they are connected. Name only what can be seen.",
    "tile": "List every device, label and connection in this part of the diagram, one bullet each.\n\nMeasured in advance:\n{cv_context}",
    "cross": "These two parts of the diagram touch. List the connections that run from one to the other.\n\nMeasured in advance:\n{cv_context}",
}
MEASURED = "\n\nMeasured in advance:\n"


def global_prompt(context: Column) -> Column:
    """The first pass's prompt; a context is put at its end if there is any."""
    return F.concat(F.lit(PROMPTS["global"]), F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(MEASURED), context)).otherwise(""))


def with_contexts(units: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """units with ``context`` by their keys; none is the empty one."""
    return units.join(contexts.select(*keys, "context"), keys, "left").withColumn("context", F.coalesce("context", F.lit("")))


def requests(views: DataFrame, tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requests of all three passes: views (image_id, image, context), tiles and pairs (image_id, ord, image, context)."""
    row = lambda df, name, order, prompt: df.select("image_id", F.lit(name).alias("pass"), order.alias("ord"), prompt.alias("prompt"), "image")
    first = row(views, "global", F.lit(0).cast("long"), global_prompt(F.col("context")))
    second = row(tiles, "tile", F.col("ord").cast("long"), text.rendered(F.lit(PROMPTS["tile"]), F.col("context")))
    third = row(pairs, "cross", F.col("ord").cast("long"), text.rendered(F.lit(PROMPTS["cross"]), F.col("context")))
    return first.unionByName(second).unionByName(third)


def fragments(url: str, model: str, prompt: str, image: bytes | None, timeout: float = 300) -> Iterator[str]:
    """The fragments of an answer as a server sends them: one JSON object a line, with ``response`` and, at the end, ``done``."""
    body = {"model": model, "prompt": prompt, "stream": True, **({"images": [base64.b64encode(image).decode()]} if image else {})}
    call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(call, timeout=timeout) as said:
            for line in said:
                if line.strip():
                    got = json.loads(line)
                    if got.get("error"):
                        raise RuntimeError(got["error"])
                    if got.get("response"):
                        yield got["response"]
                    if got.get("done"):
                        return
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise TimeoutError(str(e.reason)) from e
        raise ConnectionError(str(e.reason)) from e


def http_client(url: str, model: str, timeout: float = 300) -> Client:
    """A client of such a server: whole answers, their fragments joined."""
    return lambda prompt, image: "".join(fragments(url, model, prompt, image, timeout))


def stub(prompt: str, image: bytes | None) -> str:
    """A client for tests: its answer says what it was asked."""
    return f"<think>{len(prompt)}</think>- seen {len(image or b'')} bytes"


def ask(requests: DataFrame, client: Client, workers: int | None = None) -> DataFrame:
    """requests (image_id, pass, ord, prompt, image) with result; at most ``workers`` calls at a time. A call that fails says so in ``error``."""
    rows = requests.select("image_id", "pass", "ord", "prompt", "image")
    if workers:
        rows = rows.repartition(workers)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said: list[str | None] = []
            wrong: list[str | None] = []
            for prompt, image in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                try:
                    said.append(client(prompt, image))
                    wrong.append(None)
                except TimeoutError:
                    said.append(None)
                    wrong.append("timeout")
                except ConnectionError:
                    said.append(None)
                    wrong.append("unreachable")
                except Exception as e:  # noqa: BLE001 - the row says what went wrong
                    said.append(None)
                    wrong.append(f"other: {e}"[:200])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(said, pa.string()), pa.array(wrong, pa.string())], names=["image_id", "pass", "ord", "result", "error"])

    kind = rows.schema["image_id"].dataType.simpleString()
    return rows.mapInArrow(fn, f"image_id {kind}, pass string, ord long, result string, error string")
