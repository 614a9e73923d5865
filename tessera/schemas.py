"""Types of the engine's tables."""

from __future__ import annotations

SMPTE = "struct<hours:int,minutes:int,seconds:int,frames:int,samples:int,rate_code:int,drop_frame:boolean>"
FRAMES = f"stream_id string, au long, au_offset long, segment long, is_major boolean, data binary, smpte {SMPTE}"
STREAMS = "stream_id string, frames long, bytes long, trailing_bytes long, resyncs long"

CONFIG = (
    "struct<format_sync:long,rate_code:int,frequency:int,samples:int,flags:int,variable_rate:boolean,peak:int,substreams:int,"
    "extended_info:int,info:int,sixch_assignment:int,eightch_assignment:int,sixch_modifier:int,eightch_modifier:int,"
    "start_gain:int,heavy_start_gain:int,extension_words:int,content:int,bytes:int>"
)
DIRECTORY = "array<struct<extra_word:boolean,restart_nonexistent:boolean,crc_present:boolean,end_ptr:int,drc_gain:int,drc_time:int>>"
RESTARTS = (
    "array<struct<substream:int,block:int,sync_word:int,output_timing:int,min_chan:int,max_chan:int,max_matrix_chan:int,"
    "max_bits:int,max_lsbs:int,lossless_check:int,hires:boolean,heavy_gain:int,heavy_time:int,assign:array<int>>>"
)
SEGMENTS = "array<struct<substream:int,blocks:int,samples:int,zero_samples:int,bytes:int>>"
PAYLOADS = "array<struct<id:int,sample_offset:long,data:binary>>"
EXTRA = f"struct<offset:int,length:int,shape:string,frame_bytes:int,version:int,key:int,payloads:{PAYLOADS},protection_at:int,primary:binary,secondary:binary>"
NOTES = "array<struct<rule:string,severity:string,bit:int>>"
UNITS = (
    f"stream_id string, au long, au_offset long, segment long, length int, input_timing int, is_major boolean, config {CONFIG}, "
    f"directory {DIRECTORY}, restarts {RESTARTS}, segments {SEGMENTS}, extra {EXTRA}, notes {NOTES}, stopped string"
)
HEADERS = f"stream_id string, segment long, is_unit boolean, restarts {RESTARTS}, stopped string"
PCM = "stream_id string, presentation int, segment long, au long, samples int, channels int, pcm binary, digest long, width long, output_timing int"
