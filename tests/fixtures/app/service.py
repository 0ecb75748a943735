from app.models import *


@decorated(option())
async def serve(model: Optional[Model], *args, limit: int = 5, **kw: Dict[str, Limit]) -> Model:
    r'''Raw docs.'''
    def inner():
        return nested_call()

    Model()
    await model.run().stop(inner())
    return Model


def plain(a, b=1):
    return serve(a)
