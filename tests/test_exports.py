"""Exports of which one file is read by many tasks."""

import json
import random

import pytest

from parley.sources import exports, readers

ODD = ['a "quoted" {word}', "back\\slash \\", '\\"', "}]{[", '"chats": {"list": [{', "\n\t  🙂", "", "{", '"messages": [', "x" * 3000]


def chat(number, size, r):
    return {"name": r.choice(ODD), "type": "personal_chat" if number % 2 else "private_supergroup", "id": number, "messages": [
        {"id": k + 1, "type": "message", "date_unixtime": str(1_700_000_000 + k), "from": r.choice(ODD), "from_id": "user7", "extra": {"nested": [{"deep": {"er": r.choice(ODD)}}]},
         "text_entities": [{"type": "plain", "text": r.choice(ODD)}, {"type": "bold", "text": r.choice(ODD)}]}
        for k in range(size)]}


def account(r):
    chats = [chat(n, size, r) for n, size in enumerate((40, 0, 1, 70, 3), 1)]
    return {"about": "{[", "personal_information": {"user_id": 1, "first_name": "{"}, "contacts": {"list": [{"name": "c", "id": 5}, {"name": "}"}]}, "chats": {"about": "x", "list": chats}, "left_chats": {"list": []}, "sessions": {"list": [{"a": 1}]}}


def rows(found):
    return [sorted((tuple(r) for r in part.collect()), key=repr) for part in found]


@pytest.mark.parametrize("indent", [None, 1])
def test_cut_files_give_what_whole_ones_give(spark, tmp_path, indent):
    r = random.Random(5)
    for name, export in (("full", account(r)), ("single", chat(9, 50, r)), ("none", {"name": "n", "type": "bot_chat", "id": 77, "messages": []})):
        (tmp_path / f"{name}.json").write_text(json.dumps(export, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    whole = rows(readers.read_export_json(spark, str(tmp_path), 5))
    assert len(whole[1]) == 164
    assert rows(readers.read_large_export(spark, str(tmp_path), 5, 3000)) == whole


def test_blocks_are_read_apart(spark, tmp_path):
    (tmp_path / "result.json").write_text(json.dumps(chat(3, 400, random.Random(1))))
    pieces = exports._pieces(spark, str(tmp_path), 20_000)
    size = (tmp_path / "result.json").stat().st_size
    assert pieces.select("_block").distinct().count() >= size // 20_000
    assert readers.read_large_export(spark, str(tmp_path), 5, 20_000)[1].count() == 400


def test_small_blocks_share_files(spark, tmp_path):
    """A file for each block would make a large export's first step one of files."""
    (tmp_path / "result.json").write_text(json.dumps(chat(3, 3000, random.Random(1))))
    pieces = exports._pieces(spark, str(tmp_path), 10_000)
    blocks, files = pieces.select("_block").distinct().count(), len(pieces.inputFiles())
    assert blocks > 64 and files <= max(blocks // 16 + 1, 4 * spark.sparkContext.defaultParallelism)
    assert pieces.groupBy("at").count().where("count > 1").isEmpty()
