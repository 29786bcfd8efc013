"""The nested description document, every field nullable."""

from __future__ import annotations

VLM = """
summary string, premise string, hook string, punchline string, transcript string, format string, setting string, topic_summary string, cta string, confidence string,
on_screen_text array<string>, format_traits array<string>, topics array<string>,
products array<struct<name:string,brand:string,prominence:string,first_seen_sec:double,value_signal:struct<acquisition_cost:string,stated_value_usd:double,value_gap_called_out:boolean>>>,
entities struct<people:array<string>,brands:array<string>,places:array<string>,organizations:array<string>>,
audio struct<kind:string,spoken_language:string,speaker_count:int>, creator_on_camera boolean,
dialogue array<struct<speaker:string,line:string>>, estimated_duration_sec double,
relationship struct<stage:string,conflict:string,register:string,resolution:string,perspective:string>,
advice struct<present:boolean,content:string,topic:string,source:string,specificity:string>,
characters struct<count:int,pairing:string,dynamic:string>,
synthetic struct<presenter:string,voice:string,signals:array<string>,certainty:string>,
pacing struct<energy_arc:string,humor_sincerity:string,speaker_dominance:string,density:string>
"""

FEED = """
code int, msg string, data struct<cursor:string,hasMore:boolean,total:bigint,
videos:array<struct<video_id:string,title:string,cover:string,origin_cover:string,play:string,wmplay:string,create_time:string,digg_count:bigint,share_count:bigint,play_count:bigint,
author:struct<id:string,unique_id:string>,music_info:struct<id:string,title:string,author:string,original:boolean>>>,
comments:array<struct<id:string,text:string,digg_count:bigint,reply_total:bigint,create_time:string,user:struct<unique_id:string>>>>
"""
