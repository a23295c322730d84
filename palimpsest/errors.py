"""What can go wrong, by kind."""


class StoreError(Exception):
    """Anything this package raises."""


class Missing(StoreError):
    """A page or manifest that is referred to is not there."""


class Corrupt(StoreError):
    """Stored bytes do not have the id that they are stored under."""


class InvalidPage(StoreError):
    """A page is too large, or a page size is no power of two in range."""


class RefExists(StoreError):
    """A branch of that name is there already, or a tag has another target."""


class NoSuchRef(StoreError):
    """No branch or tag has that name."""


class Conflict(StoreError):
    """The branch has moved since the transaction began."""


class PoolBoundary(StoreError):
    """An object of one pool was asked for in another."""


class NotDurable(StoreError):
    """Local pages would be dropped that no other tier has."""


class Unsupported(StoreError):
    """A fleet query asks for what partial results cannot be merged into."""


class Truncated(StoreError):
    """A bounded search ended before it had found everything."""
