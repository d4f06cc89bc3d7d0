"""Tables and rows that several tests use."""

COUNT = {"name": "count", "type": "count"}
INAPP = {"name": "events", "dimensions": [{"name": "country"}, {"name": "event_name", "length": 20}, {"name": "install_time", "type": "uint"}], "metrics": [COUNT, {"name": "revenue", "type": "double_sum"}]}
BASIC = ["US purchase 20141112 0.1", "US purchase 20141113 1.1", "US donate 20141112 5.0"]
SORT = ["US purchase 20141110 0.1", "IL refund 20141111 1.01", "CH refund 20141111 1.1", "AZ refund 20141111 1.1", "RU donate 20141112 1.0", "KZ review 20141113 5.0"]
USERS = {"name": "events", "dimensions": [{"name": "country"}, {"name": "event_name"}, {"name": "time", "type": "uint"}], "metrics": [{"name": "user_id", "type": "bitset"}]}
USER_ROWS = ["US purchase 1495475514 12345", "RU support 1495475517 12346", "US openapp 1495475632 12347", "IL purchase 1495475715 12348", "KZ closeapp 1495475716 12349", "US uninstall 1495475809 12350", "KZ purchase 1495475808 12351", "US purchase 1495476000 12352"]
TIME = {"name": "events", "dimensions": [{"name": "country"}, {"name": "event_name"}, {"name": "install_time", "type": "time"}], "metrics": [COUNT]}
TIME_ROWS = ["US purchase 1420107084", "RU support 1420150284", "US openapp 1420178111", "IL purchase 1420287194", "KZ closeapp 1420257600", "US uninstall 1420495805", "KZ purchase 1420488000", "US purchase 1420625132"]
TENANTS = {"name": "events", "dimensions": [{"name": "app_id"}, {"name": "country"}, {"name": "event_name"}, {"name": "time", "type": "uint"}], "metrics": [{"name": "value", "type": "long_sum"}, COUNT]}
TENANT_ROWS = ["com.bee US purchase 1495475514 15", "com.bee RU support 1495475517 23", "com.horse US openapp 1495475632 137", "com.horse IL purchase 1495475715 148", "com.horse KZ closeapp 1495475716 19", "com.bird US uninstall 1495475809 35", "com.bird KZ purchase 1495475808 231", "com.bird US purchase 1495476000 32"]


def split(rows):
    return [r.split(" ") for r in rows]
