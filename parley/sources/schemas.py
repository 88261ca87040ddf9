"""Declared schemas of the archive's tables and of what is read into it."""

from __future__ import annotations

ARCHIVE: dict[str, str] = {
    "peers": "peer_id long, peer_type string, name string, username string, phone string, raw binary, updated_at long",
    "messages": "peer_id long, message_id long, sender_id long, date long, text string, entities_json string, edit_date long, state string, reply_to_msg_id long, reply_to_top_id long, reply_to_peer_id long, grouped_id long, forward_json string, reactions_json string, views int, forwards_count int, is_service boolean, raw binary",
    "message_revisions": "revision_no long, peer_id long, message_id long, text string, entities_json string, edit_date long, captured_at long",
    "message_replies": "source_peer_id long, source_message_id long, target_peer_id long, target_message_id long, status string",
    "media_objects": "media_id string, kind string, mime_type string, size_bytes long, sha256 string, local_rel_path string, download_status string, verification_status string, filter_decision string, filter_reason string, policy_version int, retry_count int, next_retry_at long, claimed_at long, created_at long",
    "message_media": "peer_id long, message_id long, media_id string, role string, position int",
    "sync_state": "peer_id long, pts int, qts int, date long, min_id long, max_id long, uncertain boolean",
    "channel_sync_queue": "peer_id long, discovered_pts int, current_pts int, status string, attempts int, updated_at long",
    "unsupported_events": "event_id string, peer_id long, kind string, affects_state boolean, observed_at long, raw binary",
    "common_deletion_tombstones": "message_id long, pts int, pts_count int, observed_at long",
    "sync_integrity_reports": "report_id string, scope string, lossless boolean, complete boolean, event_window_lost boolean, created_at long",
}
VERSION = 5

#: One tagged row per event of an update feed.
UPDATES = "kind string, slice_id long, seq long, peer_id long, message_id long, date long, text string, state string, edit_date long, views long, pts long, pts_count long, affects_state boolean, peer struct<peer_id:long,peer_type:string,name:string,username:string,updated_at:long>"

_CHAT = """struct<name:string,type:string,id:long,messages:array<struct<
 id:long,type:string,date:string,date_unixtime:string,edited_unixtime:string,actor:string,actor_id:string,action:string,title:string,`from`:string,from_id:string,reply_to_message_id:long,forwarded_from:string,
 text_entities:array<struct<type:string,text:string,href:string,document_id:string>>,reactions:array<struct<type:string,count:int,emoji:string,document_id:string>>,
 file:string,file_name:string,file_size:long,mime_type:string,media_type:string,photo:string,photo_file_size:long>>>"""
EXPORT = f"name string, type string, id long, messages {_CHAT.split('messages:', 1)[1][:-1]}, chats struct<list:array<{_CHAT}>>, personal_information struct<user_id:long,first_name:string,last_name:string,username:string>".replace("\n", " ")
