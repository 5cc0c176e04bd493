"""Log layouts read from the topic (fixed values: field names and types of the messages)."""

# {"timestamp": 1718381882, "username": "..."}; seconds or milliseconds, see event_time(unit=)
USER_LOG = "timestamp long, username string"

# login_action is "failed" or "success"; an integer timestamp is read as epoch seconds
LOGIN_LOG = "username string, timestamp timestamp, login_action string"

# action is "denied" or "accessed"; timestamp in milliseconds
ACCESS_LOG = "timestamp long, username string, action string"

# the part of a Kafka record this library reads
ENVELOPE = "value binary, topic string, partition int, offset long, timestamp timestamp"
