"""What can go wrong, by kind."""


class StoreError(RuntimeError):
    """The base of all errors here."""


class NotFound(StoreError):
    pass


class Corrupt(StoreError):
    pass


class InvalidArgument(StoreError, ValueError):
    pass


class InvalidQuery(StoreError, ValueError):
    pass


class UnsupportedQueryOp(InvalidQuery):
    pass


class AlreadyExists(StoreError):
    pass


class Full(StoreError):
    pass
