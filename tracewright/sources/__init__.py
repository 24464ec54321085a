from .custom import event_source
from .logs import dict_ocel_log, from_table, log_source, ocel2_json_log, string_log, topic_events, xes_log
from .sinks import committed, event_sink

__all__ = ["committed", "dict_ocel_log", "event_sink", "event_source", "from_table", "log_source", "ocel2_json_log", "string_log", "topic_events", "xes_log"]
