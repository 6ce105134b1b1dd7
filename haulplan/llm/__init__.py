"""Text and corpus operators; nothing else in the library imports this folder.

Records: a shipment's free text is its ``delivery_hub`` field, beside the key
``shipment_id`` and the labels ``pickup_hub`` and ``goods_type``. Operators read
only the columns they name, so extra columns of any name are ignored.
"""
