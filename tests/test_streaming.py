import json
import os
import tempfile

from refrain.streaming.logs import stream_messages, stream_rule_matches


def test_stream_messages_and_rules(spark):
    root = tempfile.mkdtemp(prefix="refrain-stream-")
    os.makedirs(os.path.join(root, "p"))
    recs = [
        {"type": "user", "uuid": "1", "timestamp": "2024-03-01T10:00:00Z", "message": {"content": "We use pytest and JWT tokens here"}},
        {"type": "assistant", "uuid": "2", "message": {"content": "ok"}},
        {"type": "user", "uuid": "3", "timestamp": "2024-03-01T10:01:00Z", "message": {"content": "short"}},
    ]
    with open(os.path.join(root, "p", "s1.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs) + "\n")
    ck = tempfile.mkdtemp(prefix="refrain-stream-ck-")
    msgs = stream_messages(spark, root)
    q1 = msgs.writeStream.format("memory").queryName("stream_msgs").option("checkpointLocation", ck + "/m").trigger(availableNow=True).start()
    q1.awaitTermination(120)
    got = {r.uuid: r.substantial for r in spark.table("stream_msgs").collect()}
    assert got == {"1": True, "3": False}
    q2 = stream_rule_matches(stream_messages(spark, root)).writeStream.format("memory").queryName("stream_rules") \
        .option("checkpointLocation", ck + "/r").trigger(availableNow=True).start()
    q2.awaitTermination(120)
    assert {(r.name, r.uuid) for r in spark.table("stream_rules").collect()} == {("no-context-preamble", "1"), ("auth-setup-repeat", "1"), ("test-framework-clarify", "1")}
